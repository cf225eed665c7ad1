"""Time series: bars, deltas against the last snapshot, sources that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str) -> DataFrame:
    """Open, high, low, close and volume per ticker and interval; ties in time go by ``seq``."""
    at = F.struct("ts", "seq")
    grouped = ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.select("ticker", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def fill_bars(found: DataFrame, width: str) -> DataFrame:
    """``found`` with empty bars (no prices, volume 0) between each ticker's first and last."""
    ends = found.groupBy("ticker").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    spine = ends.select("ticker", F.explode(F.sequence("first", "last", F.expr(f"interval {width}"))).alias("bucket"))
    return spine.join(found, ["ticker", "bucket"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def _before(c: str) -> Column:
    return F.coalesce(F.lag(c).over(Window.partitionBy("name").orderBy("date")), F.lit(0))


def repo_deltas(snapshots: DataFrame) -> DataFrame:
    """Changes against the snapshot before (0 if none); momentum is the activity's change, negative when stars fall. A null name gives zeros."""
    named = F.col("name").isNotNull()
    moved = lambda c: F.when(named, F.col(c) - _before(c)).otherwise(0)
    rows = snapshots.select("name", "date", moved("stars").cast("long").alias("stars_delta"), moved("forks").cast("long").alias("forks_delta"), moved("activity_score").cast("double").alias("activity_change"))
    return rows.withColumn("momentum_score", F.col("activity_change") * F.when(F.col("stars_delta") >= 0, 1.0).otherwise(-1.0))


def model_deltas(snapshots: DataFrame) -> DataFrame:
    named = F.col("name").isNotNull()
    moved = lambda c: F.when(named, F.col(c) - _before(c)).otherwise(0).cast("long")
    share = lambda c: (F.col(c) - _before(c)) / F.greatest(_before(c), F.lit(1))
    trending = F.when(named, share("downloads") * 0.6 + share("likes") * 0.4).otherwise(0.0)
    return snapshots.select("name", "date", moved("downloads").alias("downloads_delta"), moved("likes").alias("likes_delta"), trending.alias("trending_score"))


def newer_than(df: DataFrame, marks: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows after their source's high-water mark (key, last); sources without a mark are taken whole."""
    met = df.join(marks.select(F.col(key).alias("mark_key"), "last"), F.col(key) == F.col("mark_key"), "left")
    return met.where(F.col("last").isNull() | (F.col(ts) > F.col("last"))).drop("mark_key", "last")


def due_sources(status: DataFrame, intervals: DataFrame, now: str) -> DataFrame:
    """(source, last, due): whether a source's interval in minutes has passed; one that never ran is due."""
    minutes = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 60
    return intervals.join(status, "source", "left").select("source", "last", F.coalesce(minutes >= F.col("minutes"), F.lit(True)).alias("due"))


def active_models(models: DataFrame, as_of: str, least: int = 1000, days: int = 90, n: int = 200) -> DataFrame:
    """Public models with more than ``least`` downloads that changed within ``days``, the most used ``n``."""
    fresh = models.where((F.col("downloads") > least) & ~F.col("private") & (F.col("last_modified") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return fresh.orderBy(F.desc("downloads"), "model_id").limit(n)
