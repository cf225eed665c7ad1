"""Sums of points over many intervals of time, of any lengths, by equi-joins.

Time is cut into bins. An interval is the points of its first and last bin that lie inside, and the bins between, which are
covered by few blocks of 2, 4, 8, ... bins; the sums of all blocks are aggregated once. So an interval costs the points of
two bins and a logarithm of its length, whatever lies between, and no window runs over a whole table. A bin that holds very
many points of a key is joined in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a bin in one part of a join.
HOT = 50_000
#: Levels of blocks; the largest spans 2^LEVELS bins.
LEVELS = 24


def _blocks(first: Column, last: Column) -> Column:
    """The blocks (level, block) that cover the bins first .. last: each is the largest that starts there, then that fits.

    Blocks of a level start at multiples of their length, so at most two of each level are taken.
    """

    def step(state: Column, level: Column) -> Column:
        low, high, taken, two = state["low"], state["high"], state["taken"], F.lit(2)
        left, right = (low <= high) & (F.pmod(low, two) == 1), (low <= high) & (F.pmod(high, two) == 0)
        own = F.array(F.when(left, F.struct(level.alias("level"), low.alias("block"))), F.when(right & ~(left & (low == high)), F.struct(level.alias("level"), high.alias("block"))))
        after, before = F.when(left, low + 1).otherwise(low), F.when(right, high - 1).otherwise(high)
        half = lambda c, none: F.when(after > before, F.lit(none)).otherwise(F.floor(c / 2)).cast("long")  # noqa: E731  once nothing is left, it stays so
        return F.struct(half(after, 1).alias("low"), half(before, 0).alias("high"), F.concat(taken, F.array_compact(own)).alias("taken"))

    start = F.struct(first.alias("low"), last.alias("high"), F.array().cast("array<struct<level:int,block:bigint>>").alias("taken"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["taken"])


def interval_sums(points: DataFrame, intervals: DataFrame, key: str, at: Column, value: Column, start: Column, stop: Column, width: int, hot: int = HOT) -> DataFrame:
    """``intervals`` with ``n_points`` and ``total``: of the key's points from ``start`` to ``stop``, both included.

    ``at`` of the points and ``start`` and ``stop`` of the intervals are longs, such as microseconds; a bin is ``width`` of
    them. ``total`` is null without points, and where all values are null.
    """
    bin_of = lambda c: F.floor(c / width).cast("long")
    rows = points.select(F.col(key).alias("p_key"), at.cast("long").alias("p_at"), value.cast("double").alias("p_value")).withColumn("bin", bin_of(F.col("p_at")))
    asked = intervals.withColumns({"i_row": F.monotonically_increasing_id(), "i_start": start.cast("long"), "i_stop": stop.cast("long")})
    part = asked.select("i_row", F.col(key).alias("i_key"), "i_start", "i_stop", bin_of(F.col("i_start")).alias("low"), bin_of(F.col("i_stop")).alias("high")).where("i_start <= i_stop")
    counted = lambda n, v: (F.sum(n).alias("n"), F.sum(v).alias("s"))

    full = rows.groupBy(F.col("p_key").alias("f_key"), F.col("bin").alias("f_bin")).agg(F.count("*").alias("c")).where(F.col("c") > hot).select("f_key", "f_bin", F.ceil(F.col("c") / hot).alias("parts"))
    one, in_bin = F.lit(1).cast("long"), F.col("bin") == F.col("f_bin")
    salted = rows.join(full, (F.col("p_key") == F.col("f_key")) & in_bin, "left").withColumn("salt", F.pmod(F.xxhash64("p_at", "p_value"), F.coalesce("parts", one))).select(*rows.columns, "salt")
    edges = part.withColumn("bin", F.explode(F.array_distinct(F.array("low", "high")))).join(full, (F.col("i_key") == F.col("f_key")) & in_bin, "left")
    edges = edges.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1)))
    at_edge = edges.alias("e").join(salted.alias("p"), (F.col("e.i_key") == F.col("p.p_key")) & (F.col("e.bin") == F.col("p.bin")) & (F.col("e.salt") == F.col("p.salt")) & F.col("p.p_at").between(F.col("e.i_start"), F.col("e.i_stop")))
    found = at_edge.groupBy("e.i_row").agg(F.count("*").alias("n"), F.sum("p.p_value").alias("s"))

    bins = rows.groupBy("p_key", "bin").agg(F.count("*").alias("n"), F.sum("p_value").alias("s"))
    each = bins.select("p_key", "n", "s", F.inline(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(F.col("bin") / F.pow(F.lit(2.0), k)).cast("long").alias("block")))))
    blocks = each.groupBy("p_key", F.col("level").alias("b_level"), F.col("block").alias("b_block")).agg(*counted("n", "s"))
    inner = part.where(F.col("high") - F.col("low") > 1).select("i_row", "i_key", F.inline(_blocks(F.col("low") + 1, F.col("high") - 1)))
    between = inner.join(blocks, (F.col("i_key") == F.col("p_key")) & (F.col("level") == F.col("b_level")) & (F.col("block") == F.col("b_block"))).groupBy("i_row").agg(*counted("n", "s"))

    sums = found.unionByName(between).groupBy("i_row").agg(*counted("n", "s"))
    return asked.join(sums, "i_row", "left").withColumns({"n_points": F.coalesce("n", F.lit(0).cast("long")), "total": F.col("s")}).drop("i_row", "i_start", "i_stop", "n", "s")
