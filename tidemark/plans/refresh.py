"""A stored bubble table that grows: a refresh computes the days after its latest one and nothing else.

Beside the table the store keeps what new days need of old ones: sums and counts that give the entity weights, and the
last ``LEAD_IN`` daily rows of each entity, which is as far back as the feature windows reach. Old days are not read
again, nor changed; signals that arrive late for them are left out. As in the plain incremental mode of the indices,
new days are normalised among themselves and scored by the range of the stored ones. :func:`late_refresh` takes late signals
in, see there.

The state of a day is written before the table's rows up to that day, which are one file under the day's name: after a
crash the same refresh starts from the same day again, and a refresh without new days writes nothing.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, materialised
from ..sources.keyed_log import KeyedLog
from . import features as ft
from . import indices as ix

LEAD_IN = 30
_ENTITY = ["entity_id", "entity_name", "entity_type"]


def weight_sums(combined: DataFrame) -> DataFrame:
    """Per entity the sum and the number of what its weights average; such rows of several periods add up."""
    parts = ix.weight_parts()
    return combined.groupBy(*_ENTITY).agg(*[f(c).alias(n + end) for n, c in parts.items() for f, end in ((F.sum, "_sum"), (F.count, "_n"))])


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy(*_ENTITY).agg(*[F.sum(c).alias(c) for c in old.columns if c not in _ENTITY])


def new_indices(new: DataFrame, sums: DataFrame) -> DataFrame:
    """Both indices of the new days, with weights from the sums over all days."""
    mean = lambda n: F.col(f"{n}_sum") / F.nullif(F.col(f"{n}_n"), F.lit(0))
    weights = sums.select("entity_id", ix.hype_weight(mean).alias("hype_weight"), ix.reality_weight(mean).alias("reality_weight"))
    return ix.daily_indices(new.join(weights, "entity_id"))


def _tail(daily: DataFrame, until: Column) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("date")))
    return daily.where(F.col("date") <= until).withColumn("rows_back", back).where(F.col("rows_back") <= LEAD_IN).drop("rows_back")


def _store(spark: SparkSession, store: str, bubble: DataFrame, sums: DataFrame, daily: dict[str, DataFrame]) -> DataFrame:
    bubble = materialised(bubble)
    until: datetime.date = bubble.agg(F.max("date")).first()[0]  # one value
    kept = {"sums": sums} | {k: _tail(d, F.lit(until)) for k, d in daily.items()}
    for name, rows in kept.items():
        rows.write.mode("overwrite").parquet(f"{store}/state/{until}/{name}")
    bubble.coalesce(1).write.mode("overwrite").parquet(f"{store}/bubble/until={until}")  # a row a day
    return bubble


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/bubble").drop("until")


def refresh(spark: SparkSession, store: str, hype: DataFrame, reality: DataFrame) -> DataFrame:
    """Adds the days after the latest stored one, or all days to a new store; returns the rows added.

    ``hype`` and ``reality``: daily rows by entity, of which those after the latest stored day are read.
    """
    if not exists(spark, f"{store}/bubble"):
        rows = materialised(ft.combined_features(ft.hype_features(hype), ft.reality_features(reality)))
        bubble = ix.bubble_metrics(ix.both_indices(rows))
        return bubble if rows.isEmpty() else _store(spark, store, bubble, weight_sums(rows), {"hype": hype, "reality": reality})
    old = stored(spark, store)
    latest: datetime.date = old.agg(F.max("date")).first()[0]  # one value; it reaches the scans as a literal
    state = lambda name: spark.read.parquet(f"{store}/state/{latest}/{name}")
    after = F.col("date") > F.lit(latest)
    daily = {k: state(k).unionByName(d.where(after)) for k, d in (("hype", hype), ("reality", reality))}
    new = materialised(ft.combined_features(ft.hype_features(daily["hype"]), ft.reality_features(daily["reality"])).where(after))
    if new.isEmpty():
        return old.limit(0)
    sums = materialised(added(state("sums"), weight_sums(new)))
    return _store(spark, store, ix.incremental_bubble(old, new_indices(new, sums)), sums, daily)


def feature_store(spark: SparkSession, store: str) -> KeyedLog:
    """The stored features of each entity and day, by month."""
    return KeyedLog(spark, f"{store}/combined", ["entity_id", "date"], F.date_format("date", "yyyy-MM"))


def _spread(daily: DataFrame, dirty: DataFrame) -> DataFrame:
    """(entity_id, date) of the days whose windows reach back to a dirty day, that day included."""
    w = Window.partitionBy("entity_id").orderBy("date").rowsBetween(-LEAD_IN, 0)
    marked = daily.select("entity_id", "date").join(dirty.withColumn("is_dirty", F.lit(1)), ["entity_id", "date"], "left")
    return marked.withColumn("touched", F.max("is_dirty").over(w)).where("touched = 1").select("entity_id", "date")


def _needed(daily: DataFrame, changed: DataFrame) -> DataFrame:
    """The daily rows that the features of the changed days read: these and the ``LEAD_IN`` rows before each."""
    w = Window.partitionBy("entity_id").orderBy("date").rowsBetween(0, LEAD_IN)
    marked = daily.join(changed.withColumn("is_changed", F.lit(1)), ["entity_id", "date"], "left")
    return marked.withColumn("needed", F.max("is_changed").over(w)).where("needed = 1").select(*daily.columns)


def late_refresh(spark: SparkSession, store: str, hype: DataFrame, reality: DataFrame, dirty: DataFrame, number: int) -> DataFrame:
    """Takes in signals for any days, late ones too: computes the features anew that they touch, and no others.

    ``dirty``: (entity_id, date) of the new signals; ``hype`` and ``reality``: daily rows with these signals, of which only
    those of the dirty entities are read. A dirty day touches itself and the days whose windows reach back to it, which are
    the entity's next ``LEAD_IN`` rows. The features replace the stored ones as batch ``number``, once. Returns what was
    computed. The table of all days then follows from :func:`late_bubble`: weights and maxima of an entity are over all its
    days, so a late row moves every index that the entity is part of, but each of these costs one sum.
    """
    marks = materialised(dirty.select("entity_id", "date").where("entity_id is not null and date is not null").distinct())
    entities = marks.select("entity_id").distinct()
    tables = [materialised(d.join(entities, "entity_id", "left_semi").select(*d.columns)) for d in (hype, reality)]
    changed = materialised(_spread(tables[0], marks).unionByName(_spread(tables[1], marks)).distinct())
    made = ft.combined_features(*[f(_needed(d, changed)) for f, d in zip((ft.hype_features, ft.reality_features), tables)])
    made = materialised(made.join(changed, ["entity_id", "date"], "left_semi").select(*made.columns))
    feature_store(spark, store).append(made, "refresh", number)
    return made


def late_bubble(spark: SparkSession, store: str) -> DataFrame:
    """The bubble table of the stored features, equal to that of a full run over all signals taken in."""
    return ix.bubble_metrics(ix.both_indices(feature_store(spark, store).table()))
