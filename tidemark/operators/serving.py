"""Queries that serve results: series, latest figures, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_series(bubble: DataFrame, first: str, last: str) -> DataFrame:
    """One point per date within [first, last]; of several rows of a date that with the largest time_id."""
    rows = bubble.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    one = rows.groupBy("date").agg(F.max_by(F.struct("hype_index", "reality_index", "hype_reality_gap", "bubble_risk_score"), "time_id").alias("r"))
    return one.select("date", "r.*")


def latest_kpis(bubble: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("date", "hype_index", "reality_index", "hype_reality_gap"), F.struct("date", "time_id"))
    return bubble.agg(F.count("*").alias("points"), last.alias("r")).select("points", F.col("r.date").alias("last_date"), "r.hype_index", "r.reality_index", "r.hype_reality_gap")


def latest_per_entity(rows: DataFrame) -> DataFrame:
    """Each named entity's row of its latest date, in one pass."""
    named = rows.where(F.coalesce("entity_name", F.lit("")) != "")
    return named.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "entity_id"]), F.struct("date", "time_id")).alias("r")).select("entity_id", "r.*")


def top_risk(rows: DataFrame, n: int = 10) -> DataFrame:
    """The entities with the largest momentum, up or down, at their latest date."""
    latest = latest_per_entity(rows.where("hype_score is not null or reality_score is not null"))
    size = F.abs(F.coalesce("bubble_momentum", F.lit(0.0)))
    two = lambda c, d: (F.round(F.coalesce(c, F.lit(0.0)), d) + F.lit(0.0)).alias(c)
    return latest.orderBy(size.desc(), "entity_name").limit(n).select("entity_name", "entity_type", two("hype_score", 2), two("reality_score", 2), two("bubble_momentum", 4))


def recent_alerts(alerts: DataFrame, entities: DataFrame, as_of: str, days: int = 30, n: int = 50) -> DataFrame:
    """Alerts of the last ``days`` with names and rounded scores, one per (entity, timestamp), newest and surest first."""
    named = alerts.join(entities.select("entity_id", "name"), "entity_id", "left").where(F.col("timestamp") >= F.date_sub(F.lit(as_of).cast("date"), days))
    two = lambda c: (F.round(F.coalesce(c, F.lit(0.0)), 2) + F.lit(0.0)).alias(c)
    cols = named.select("entity_id", F.coalesce("name", F.lit("Unknown")).alias("entity_name"), "timestamp", "alert_level", two("divergence_score"), two("acceleration_score"), two("pattern_score"), two("confidence"))
    first = F.row_number().over(Window.partitionBy("entity_name", "timestamp").orderBy(F.desc("confidence"), "alert_level", "entity_id"))
    one = cols.withColumn("rn", first).where("rn = 1").drop("rn", "entity_id")
    return one.orderBy(F.desc("timestamp"), F.desc("confidence"), "entity_name").limit(n)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_level").agg(F.count("*").alias("n"))
