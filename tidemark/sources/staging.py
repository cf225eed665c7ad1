"""Staging tables: reads with a fixed schema, writes, retention, upserts, wide and long prices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import STAR


def read_staging(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_staging(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_raw_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_raw_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def create_schema(spark: SparkSession, database: str) -> None:
    """The star schema's tables, where they do not exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in STAR.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace('struct<divergence:double,acceleration:double,pattern_similarity:double>', 'struct<divergence: double, acceleration: double, pattern_similarity: double>')}) USING parquet")


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def history_store(df: DataFrame, path: str, data_type: str, timeframe: str) -> None:
    """Replace the history of one data type and timeframe, and of no other."""
    keyed = df.withColumns({"data_type": F.lit(data_type), "timeframe": F.lit(timeframe)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_type", "timeframe").parquet(path)


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in the (total) order; nulls come first."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("rank_in_key", F.row_number().over(w)).where("rank_in_key = 1").drop("rank_in_key")


def append_retain_dedup(existing: DataFrame, new: DataFrame, keys: list[str], ts: str, as_of: str, days: int = 30, order: list[str] | None = None) -> DataFrame:
    """Both tables' rows of the last ``days``, one per key, the latest."""
    both = existing.unionByName(new, allowMissingColumns=True).where(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days))
    return keep_latest(both, keys, order or [ts])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with ``updates`` in place of the rows that share their keys."""
    return updates.unionByName(target.join(updates.select(*keys).distinct(), keys, "left_anti"))


def flatten_columns(df: DataFrame) -> DataFrame:
    """Names such as ``('Close', 'NVDA')`` as ``Close_NVDA``."""
    flat = {c: "_".join(p for p in re.findall(r"'([^']*)'", c) if p) for c in df.columns if re.fullmatch(r"\(.*\)", c)}
    return df.withColumnsRenamed({c: n for c, n in flat.items() if n})


def _date_column(df: DataFrame) -> str:
    for c in df.columns:
        if c.lower() in ("date", "datetime", "timestamp", "index"):
            return c
    raise ValueError("no date column")


def prices_to_long(df: DataFrame) -> DataFrame:
    """(date, ticker, close, volume) from wide columns ``Close_<T>`` and ``Volume_<T>``, from long rows, or from wide rows with a ticker."""
    df = flatten_columns(df)
    date = F.to_date(F.col(f"`{_date_column(df)}`")).alias("date")
    names = {c.lower(): c for c in df.columns}
    tickers = [c[6:] for c in df.columns if c.startswith("Close_")]
    if "ticker" in names and "close" in names:
        volume = F.col(names["volume"]).cast("double") if "volume" in names else F.lit(None).cast("double")
        return df.select(date, F.col(names["ticker"]).alias("ticker"), F.col(names["close"]).cast("double").alias("close"), volume.alias("volume"))
    if not tickers:
        return df.select(date, F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume")).limit(0)
    one = lambda t: F.struct(F.lit(t).alias("ticker"), F.col(f"`Close_{t}`").cast("double").alias("close"), (F.col(f"`Volume_{t}`").cast("double") if f"Volume_{t}" in df.columns else F.lit(None).cast("double")).alias("volume"))
    each = df.select(date, *([F.col(names["ticker"]).alias("row_ticker")] if "ticker" in names else []), F.explode(F.array(*map(one, tickers))).alias("p"))
    if "ticker" in names:
        each = each.where("p.ticker = row_ticker")
    return each.select("date", "p.*").where("close is not null or volume is not null")


def prices_to_wide(df: DataFrame, tickers: list[str], values: dict[str, str], order: str = "ts") -> DataFrame:
    """One row per date with ``<Value>_<ticker>`` columns; of several rows the last by ``order`` wins. Tickers are given, so no extra pass."""
    wide = df.groupBy("date").pivot("ticker", tickers).agg(*[F.max_by(c, order).alias(n) for n, c in values.items()])
    return wide.withColumnsRenamed({f"{t}_{n}": f"{n}_{t}" for t in tickers for n in values})


def merge_wide(existing: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """Rows of both, one per date, those of ``new`` first."""
    a, b = existing.withColumn("from_new", F.lit(0)), new.withColumn("from_new", F.lit(1))
    return keep_latest(a.unionByName(b, allowMissingColumns=True), [date], ["from_new"]).drop("from_new")
