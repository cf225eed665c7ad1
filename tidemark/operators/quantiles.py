"""Exact quantiles of groups of any size, by passes over mergeable sketches; no task sorts or holds a large group.

Each wanted order statistic has bounds that it lies between. A pass asks an approximate quantile sketch of what lies
between them for values a little below and above the wanted rank, and counts exactly how many are below and between. Once
few values are left, or all that are left are equal, the rank is read off them. Where a sketch does not help, the bounds
are halved instead, so the result is exact in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised

#: Values of a group that may be sorted in one task, and the sketch's accuracy and its cuts.
FEW, ACCURACY, CUTS = 10_000, 2_000, 500
#: Passes; each leaves about a hundredth of the values, or half of the bounds.
MAX_PASSES = 200


def _between(own: DataFrame, asked: DataFrame) -> DataFrame:
    """The values within the bounds of each statistic asked for (key, rank, low, high, ...)."""
    met = own.join(asked.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).drop("of")
    return met.where(F.col("v").between(F.col("low"), F.col("high")))


_STATE = ["key", "rank", "below", "inside", "low", "high"]


def _sketched(own: DataFrame, asked: DataFrame) -> DataFrame:
    """New bounds by a sketch, of the statistics that it helps."""
    within, slack = (F.col("rank") - F.col("below")) / F.col("inside"), 3.0 / ACCURACY
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), ACCURACY)
    place = lambda x: (F.least(F.greatest(x, F.lit(0)), F.lit(CUTS)) + 1).cast("int")
    pivots = _between(own, asked).groupBy(*_STATE).agg(cuts.alias("cuts"))
    pivots = materialised(pivots.select(*_STATE, F.element_at("cuts", place(F.floor((within - slack) * CUTS) - 1)).alias("from"), F.element_at("cuts", place(F.ceil((within + slack) * CUTS) + 1)).alias("to")))
    less, mid = F.count(F.when(F.col("v") < F.col("from"), 1)), F.count(F.when(F.col("v").between(F.col("from"), F.col("to")), 1))
    counted = _between(own, pivots).groupBy(*_STATE, "from", "to").agg(less.alias("less"), mid.alias("mid"))
    left = F.col("rank") - F.col("below") - F.col("less")
    return counted.where((left >= 0) & (left < F.col("mid")) & (F.col("mid") < F.col("inside"))).select("key", "rank", (F.col("below") + F.col("less")).alias("below"), F.col("mid").alias("inside"), F.col("from").alias("low"), F.col("to").alias("high"))


def _halved(own: DataFrame, asked: DataFrame) -> DataFrame:
    """New bounds by the middle of the old ones."""
    down = F.col("v") <= F.col("low") / 2 + F.col("high") / 2
    left_high, right_low = F.max(F.when(down, F.col("v"))), F.min(F.when(~down, F.col("v")))
    sides = _between(own, asked).groupBy(*_STATE).agg(F.count(F.when(down, 1)).alias("c"), left_high.alias("left_high"), right_low.alias("right_low"))
    lower = F.col("rank") - F.col("below") < F.col("c")
    either = lambda a, b: F.when(lower, a).otherwise(b)
    return sides.select(
        "key", "rank", either(F.col("below"), F.col("below") + F.col("c")).alias("below"), either(F.col("c"), F.col("inside") - F.col("c")).alias("inside"), either(F.col("low"), F.col("right_low")).alias("low"),
        either(F.col("left_high"), F.col("high")).alias("high"),
    )


def exact_quantiles(rows: DataFrame, key: str, value: str, probs: list[float], few: int = FEW) -> DataFrame:
    """``key, prob, n, quantile``: quantiles with linear interpolation, as ``quantile_cont``.

    Null values do not count, and rows without a key belong to no group. ``rows`` is read twice a pass.
    """
    own = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and key is not null")
    ends = materialised(own.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    wanted = ends.select("key", "n", F.explode(F.array(*map(F.lit, map(float, probs)))).alias("prob"))
    wanted = wanted.withColumn("at", F.col("prob") * (F.col("n") - 1)).withColumn("first", F.floor("at").cast("long")).withColumn("second", F.least(F.col("first") + 1, F.col("n") - 1))
    ranks = wanted.select("key", F.explode(F.array("first", "second")).alias("rank")).distinct()
    state = materialised(ranks.join(ends, "key").select("key", "rank", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "low", "high"))
    wide = (F.col("inside") > few) & (F.col("low") < F.col("high"))
    for _ in range(MAX_PASSES):
        asked = state.where(wide)
        if asked.isEmpty():
            break
        new = materialised(_sketched(own, asked))
        if new.isEmpty():
            new = materialised(_halved(own, asked))
        state = materialised(state.join(new.select("key", "rank"), ["key", "rank"], "left_anti").unionByName(new))
    else:
        raise RuntimeError("quantiles have not settled")
    held = _between(own, state.where("low < high")).groupBy("key", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # ``few`` at most
    place = (F.col("rank") - F.col("below") + 1).cast("int")
    found = materialised(state.join(held, ["key", "rank"], "left").select("key", "rank", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.try_element_at("vs", place)).alias("v")))
    of = lambda name: found.select("key", F.col("rank").alias(name), F.col("v").alias(f"{name}_v"))
    met, part = wanted.join(of("first"), ["key", "first"]).join(of("second"), ["key", "second"]), F.col("at") - F.col("first")
    between = F.col("first_v") * (1 - part) + F.col("second_v") * part
    return met.select(F.col("key").alias(key), "prob", "n", F.when(F.col("first_v") == F.col("second_v"), F.col("first_v")).otherwise(between).alias("quantile"))
