"""Dimensions and facts: surrogate keys, calendars, loads that leave out what is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import exists, materialised
from ..sources.staging import keep_latest


def number(df: DataFrame, key: str, *order: str, start: int = 0) -> DataFrame:
    """``df`` with ``key`` = start + row number in the total order given. For dimensions, which fit a task."""
    return df.select((F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in order])) + F.lit(start)).cast("long").alias(key), "*")


def assign_keys(df: DataFrame, key: str, order: list[str], start: int = 0) -> DataFrame:
    """As :func:`number`, for tables of any size: range-partitioned, with an offset per partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(parts, *cols).withColumn("key_part", F.spark_partition_id())
    counts = ranged.groupBy("key_part").agg(F.count("*").alias("key_rows"))  # one row per partition
    before = counts.select("key_part", (F.sum("key_rows").over(Window.orderBy("key_part")) - F.col("key_rows")).alias("key_before"))
    row = F.row_number().over(Window.partitionBy("key_part").orderBy(*cols))
    numbered = ranged.withColumn("key_row", row).join(F.broadcast(before), "key_part")
    return numbered.withColumn(key, (F.col("key_before") + F.col("key_row") + start).cast("long")).drop("key_part", "key_row", "key_before")


#: Members of a dimension that are numbered in one task.
FEW_MEMBERS = 200_000


def member_keys(df: DataFrame, key: str, *order: str, few: int = FEW_MEMBERS) -> DataFrame:
    """``df`` with :func:`number`'s keys; beyond ``few`` rows, by count, over ranges. ``df`` is computed once."""
    rows = materialised(df)
    return number(rows, key, *order) if rows.count() <= few else assign_keys(rows, key, list(order)).select(key, *rows.columns)


def counted(df: DataFrame, few: int = FEW_MEMBERS) -> DataFrame:
    """``df``, computed once, to be joined: sent to all tasks up to ``few`` rows, by count; beyond, the same join is shuffled."""
    rows = materialised(df)
    return F.broadcast(rows) if rows.count() <= few else rows


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Epoch seconds, ISO week, month, year and whether the day is a weekday."""
    d = F.col(date)
    return df.withColumns({
        "unix_ts": (F.unix_date(d).cast("long") * 86400), "week": F.weekofyear(d), "month": F.month(d), "year": F.year(d), "is_business_day": ~F.dayofweek(d).isin(1, 7),
    })


def unseen(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``known``; rows with a null key are left out."""
    return new.dropna(subset=keys).join(known.select(*keys).distinct(), keys, "left_anti")


def extend_dimension(candidates: DataFrame, existing: DataFrame, key: str, natural: list[str], order: list[str]) -> DataFrame:
    """The rows to append to a dimension: distinct, new by their natural key, numbered after the largest id."""
    new = unseen(candidates.distinct(), existing, natural)
    largest = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("largest_key"))
    numbered = member_keys(new, key, *order).crossJoin(F.broadcast(largest))  # one row
    return numbered.withColumn(key, F.col(key) + F.col("largest_key")).drop("largest_key")


def lookup(rows: DataFrame, on: str, known: DataFrame, by: str, key: str) -> DataFrame:
    """``rows`` with ``key`` of the row of ``known`` whose ``by`` equals their ``on``, the smallest of several.

    The job fails on a value that is not known, and on a null. Of ``known``, up to a count, no shuffle of ``rows`` is needed.
    """
    one = counted(known.groupBy(F.col(by).alias("lookup_value")).agg(F.min(key).alias("lookup_key")))
    told = F.concat(F.lit(f"no {key} for {on}: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    found = F.coalesce("lookup_key", F.raise_error(told).cast(known.schema[key].dataType))
    return rows.join(one, F.col(on) == F.col("lookup_value"), "left").withColumn(key, found).drop("lookup_value", "lookup_key")


def _matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` that are in ``other`` by ``keys`` (left_semi) or are not (left_anti); nulls are equal."""
    there = other.select(*[F.col(k).alias(f"known_{k}") for k in keys])
    return rows.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]), how)


def fresh_facts(new: DataFrame, loaded: DataFrame, keys: list[str], few: int = FEW_MEMBERS) -> DataFrame:
    """Facts whose keys are not loaded yet. Nulls in keys are equal, so that a second load adds nothing.

    Only keys are compared, so the other columns of ``new`` stay where they are: facts of a first key (the day) that nothing
    is loaded of are taken as they come, of the other days those of the keys found. These are sent to all tasks up to ``few``,
    by count; beyond, the facts of those days alone are shuffled, without a sort.
    """
    fresh = materialised(_matched(new.select(*keys).distinct(), loaded.select(*keys).distinct(), keys, "left_anti"))
    day = keys[:1]
    seen = counted(loaded.select(*day).distinct(), few)
    late = materialised(_matched(fresh, seen, day, "left_semi"))
    n_fresh, n_late = fresh.count(), late.count()
    on_time = _matched(new, seen, day, "left_anti")
    if n_late == 0:
        return on_time if n_fresh else new.limit(0)
    of_days = _matched(new, late.hint("broadcast" if n_late <= few else "shuffle_hash"), keys, "left_semi")
    return on_time.unionByName(of_days) if n_fresh > n_late else of_days


def append_facts(new: DataFrame, path: str, keys: list[str], one_per_key: bool = False) -> None:
    """Appends to the table at ``path``, if need be a new one, what it does not hold by ``keys``.

    Rows that share a key within ``new`` are all loaded, as several filings of a day are; with ``one_per_key`` the last of
    them by the other columns.
    """
    spark, rest = new.sparkSession, [c for c, kind in new.dtypes if c not in keys and "map<" not in kind]
    if one_per_key:
        new = keep_latest(new, keys, rest) if rest else new.dropDuplicates(keys)
    if exists(spark, path):
        new = fresh_facts(new, spark.read.parquet(path), keys)
    new.write.mode("append").option("compression", "zstd").parquet(path)  # facts may hold texts


def star_facts(rows: DataFrame, when: Column, entity: Column, times: DataFrame, entities: DataFrame, by: str = "name", entity_type: str | None = None) -> DataFrame:
    """``rows`` with time_id and entity_id. By default an entity is met by name alone and may fan out over its types."""
    keyed = rows.withColumn("fact_date", when).withColumn("fact_entity", entity).where("fact_date is not null and fact_entity is not null")
    known = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    dated = keyed.join(counted(times.select(F.col("date").alias("fact_date"), "time_id")), "fact_date")
    return dated.join(counted(known.select(F.col(by).alias("fact_entity"), "entity_id")), "fact_entity").drop("fact_date", "fact_entity")


def melt_metrics(rows: DataFrame, metrics: dict[str, tuple[str, str]], provenance: str) -> DataFrame:
    """One fact per metric that is not null, in one scan. ``metrics``: column to (metric_name, unit)."""
    structs = [F.struct(F.lit(name).alias("metric_name"), F.col(c).cast("double").alias("metric_value"), F.lit(unit).alias("metric_unit")) for c, (name, unit) in metrics.items()]
    each = rows.select("time_id", "entity_id", F.explode(F.filter(F.array(*structs), lambda s: s["metric_value"].isNotNull())).alias("m"))
    return each.select("time_id", "entity_id", "m.*", F.lit(provenance).alias("provenance"))
