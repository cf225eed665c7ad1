"""Data-quality checks: counts, keys, duplicates, gaps, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_gaps(df: DataFrame, date: str, longer_than: int, *keys: str) -> DataFrame:
    """Neighbouring dates (of each key) that lie more than ``longer_than`` days apart."""
    w = Window.partitionBy(*keys).orderBy(date)
    rows = df.select(*keys, F.col(date), F.lead(date).over(w).alias("next_date"))
    return rows.withColumn("gap_days", F.datediff("next_date", date)).where(F.col("gap_days") > longer_than)


def null_keys(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).select(F.lit(name).alias("table_name"), F.expr("stack({}, {}) as (column_name, nulls)".format(len(columns), ", ".join(f"'{c}', {c}" for c in columns))))


def bad_scores(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key how many scores are null or NaN, where any are."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"bad_{c}")
    return df.groupBy(key).agg(*[bad(c) for c in columns]).where(" + ".join(f"bad_{c}" for c in columns) + " > 0")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Up to ``n`` rows of each key that occurs more than once."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("copies", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(*order)))
    return ranked.where((F.col("copies") > 1) & (F.col("rn") <= n))


def coverage(df: DataFrame, key: str, date: str) -> DataFrame:
    """Per key: rows, first and last date, days between, distinct dates."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.datediff(F.max(date), F.min(date)).alias("span_days"), F.count_distinct(date).alias("dates")
    )


def sample_buckets(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many samples."""
    n = F.col("n")
    bucket = F.when(n < 5, "under 5").when(n < 10, "5 to 9").when(n < 30, "10 to 29").otherwise("30 and more")
    return df.groupBy(key).agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("samples"))


def freshness(df: DataFrame, key: str, date: str, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumns({"days_old": F.datediff(day, F.col("last_date")), "has_today": F.col("last_date") == day})


def reconcile(staging: DataFrame, warehouse: DataFrame, key: str, entity: str) -> DataFrame:
    """Rows and distinct entities per key on both sides, and how far they differ."""
    side = lambda df, s: df.groupBy(F.col(key).alias(f"{s}_key")).agg(F.count("*").alias(f"{s}_rows"), F.count_distinct(entity).alias(f"{s}_entities"))
    met = side(staging, "staging").join(side(warehouse, "warehouse"), F.col("staging_key") == F.col("warehouse_key"), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(F.coalesce("staging_key", "warehouse_key").alias(key), *[zero(f"{s}_{k}") for s in ("staging", "warehouse") for k in ("rows", "entities")]).withColumn("missing_rows", F.col("staging_rows") - F.col("warehouse_rows"))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.subtract(right).withColumn("side", F.lit("only_first")).unionByName(right.subtract(left).withColumn("side", F.lit("only_second")))
