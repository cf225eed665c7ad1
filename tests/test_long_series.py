"""Series in chunks: the results are those of plain windows, whatever the length of a chunk."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import chunks, detect
from tidemark.plans import features

DAY = dt.date(1900, 1, 1)


def pairs(spark, lengths, seed=1):
    dice, rows = random.Random(seed), []
    for e, n in enumerate(lengths):
        rows += [(e, DAY + dt.timedelta(days=i), float(dice.choice((0, 0, 1, 2, 3, dice.randrange(30)))), float(dice.randrange(5))) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id long, date date, hype double, reality double")


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_select_among_first_values():
    dice = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        v = dice.integers(0, 9, n).astype(float)
        lengths = dice.integers(1, n + 1, 50)
        ranks = np.array([dice.integers(0, k) for k in lengths])
        assert detect.prefix_select(v, lengths, ranks).tolist() == [sorted(v[:k])[r] for k, r in zip(lengths, ranks)]
    v = dice.normal(size=200)
    for before, cut in ((0, 0), (150, 10)):
        prior = np.sort(v[:before])
        got = detect.expanding_quantile(v[before:], before, prior[cut:], cut, 0.25)
        assert np.allclose(got, [np.quantile(v[: before + i + 1], 0.25) for i in range(200 - before)])


@pytest.mark.parametrize("size", [7, 50, 400])
def test_asof_scores_in_chunks_equal_those_of_windows(spark, size):
    rows = pairs(spark, [3, 5, 60, 137, 0, 200])
    plain, long = (as_dict(detect.asof_scores(rows, short=s, size=size), "entity_id", "date") for s in (1000, 100))
    every = as_dict(detect.asof_scores(rows, short=0, size=size), "entity_id", "date")
    assert plain.keys() == long.keys() == every.keys() and len(plain) == 1 + 56 + 133 + 196
    for k, r in plain.items():
        for other in (long[k], every[k]):
            for c in ("divergence_z", "acceleration_z"):
                assert (r[c] is None) == (other[c] is None) and (r[c] is None or math.isclose(r[c], other[c], rel_tol=1e-7, abs_tol=1e-7)), (k, c, r[c], other[c])


def test_asof_scores_of_a_hundred_thousand_days(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("entity_id"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), (F.xxhash64("id") % 1000).cast("double").alias("hype"), (F.xxhash64(-F.col("id")) % 50).cast("double").alias("reality"))
    began = time.time()
    last = detect.asof_scores(rows, size=5_000).orderBy(F.desc("date")).first()
    assert time.time() - began < 200
    local = rows.orderBy("date").toPandas()
    h, r = local["hype"].to_numpy(), local["reality"].to_numpy()
    iqr = lambda x: np.quantile(x, 0.75) - np.quantile(x, 0.25)
    d = h / iqr(h) - r / iqr(r)
    assert math.isclose(last.divergence_z, (d[-1] - d.mean()) / d.std(), rel_tol=1e-7)


def test_windows_and_sums_of_a_hot_entity(spark):
    rows = pairs(spark, [400, 9, 31, 1], seed=4).withColumnRenamed("hype", "x")
    w = Window.partitionBy("entity_id").orderBy("date")

    def compute(df, window):
        return df.withColumns({"avg7": F.avg("x").over(window.rowsBetween(-6, 0)), "dev30": F.stddev_samp("x").over(window.rowsBetween(-29, 0)), "lag30": F.lag("x", 30).over(window)})

    want = as_dict(compute(rows, w), "entity_id", "date")
    for size in (4, 64):
        assert as_dict(chunks.windowed(rows, ["entity_id"], ["date"], size, 30, compute).select(*want[next(iter(want))].__fields__), "entity_id", "date") == want
    sums = chunks.running(chunks.chunked(rows, ["entity_id"], ["date"], 16), ["entity_id"], {"t": F.col("x")})
    assert as_dict(sums.select("entity_id", "date", "t"), "entity_id", "date") == as_dict(rows.select("entity_id", "date", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t")), "entity_id", "date")
    at = chunks.chunked(rows, ["entity_id"], ["date"], 16)
    assert at.groupBy("entity_id", chunks.CHUNK).count().agg(F.max("count")).first()[0] == 16
    assert at.select(chunks.ROW, F.row_number().over(w).alias("n")).where(f"{chunks.ROW} <> n").isEmpty()


def test_twenty_rounds_of_change_points_are_linear(spark):
    dice, rows = random.Random(2), pairs(spark, [120, 2, 45, 1], seed=6).withColumnRenamed("hype", "divergence").drop("reality")
    found = detect.changepoints(rows, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Exchange") <= 21  # rounds are written
    got = sorted((r.entity_id, r["round"], r.date, round(r.gain, 6)) for r in found.collect())
    assert got == sorted((r.entity_id, r["round"], r.date, round(r.gain, 6)) for r in detect.changepoints(rows, 20, size=8).collect())
    series = {}
    for r in sorted(rows.collect(), key=lambda r: r.date):
        series.setdefault(r.entity_id, []).append((r.date, r.divergence))
    want = []
    for e, own in series.items():
        x, parts = np.array([v for _, v in own]), [(0, len(own))]
        cost = lambda a, b: x[a:b].sum() ** 2 / (b - a)  # noqa: E731, B023
        for number in range(1, 21):
            options = [(round(cost(a, k) + cost(k, b) - cost(a, b), 9), -k, a, b) for a, b in parts for k in range(a + 1, b)]
            if not options:
                break
            gain, k, a, b = max(options)
            parts = [p for p in parts if p != (a, b)] + [(a, -k), (-k, b)]
            want.append((e, number, own[-k - 1][0], round(gain, 6)))
    assert got == sorted(want) and dice


def test_entity_correlation_equals_that_of_pairs(spark):
    dice = random.Random(3)
    rows = [(DAY + dt.timedelta(days=d), e, None if dice.random() < 0.1 else (1.0 if e == 3 else dice.random())) for e in range(9) for d in range(70) if dice.random() < 0.8 and not (e == 7 and d < 60)]
    daily = spark.createDataFrame(rows, "date date, entity_id long, x double")
    want = as_dict(features.correlation_per_entity(features.pair_correlation(daily, "x")), "date", "entity_id")
    for block in (2, 4, 32):
        got = as_dict(features.entity_correlation(daily, "x", block=block), "date", "entity_id")
        assert got.keys() == want.keys()
        assert all((want[k].correlation is None) == (got[k].correlation is None) and (want[k].correlation is None or math.isclose(want[k].correlation, got[k].correlation, abs_tol=1e-9)) for k in want)
    shuffled = features.entity_correlation(daily, "x", block=32)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shuffled
    assert features.entity_correlation(daily.limit(0), "x").count() == 0


def test_pruned_templates_do_not_change_the_nearest(spark):
    dice = np.random.default_rng(5)
    shapes = [detect._normal(dice.normal(size=n).cumsum()) for n in (5, 12, 30, 30, 8, 21, 40, 1)]
    for n in (1, 2, 25, 60):
        own = detect._normal(dice.normal(size=n).cumsum())
        each = [detect.warped_distance(own, s) for s in shapes]
        bounds = detect.bounds_below(own, shapes)
        assert all(b <= d * d + 1e-9 for b, d in zip(bounds, each))
        distance, at, compared = detect.nearest_shape(own, shapes)
        assert math.isclose(distance, min(each)) and math.isclose(each[at], distance) and 1 <= compared <= len(shapes)
    series = spark.createDataFrame([(e, DAY + dt.timedelta(days=i), float(v)) for e in range(6) for i, v in enumerate(shapes[e])], "entity_id long, date date, divergence double")
    points = spark.createDataFrame([(f"t{k}", i, float(v)) for k, s in enumerate(shapes) for i, v in enumerate(s)], "template string, pos int, value double")
    found = detect.pattern_search(series, points)
    assert {r.entity_id: (r.template, round(r.pattern, 6)) for r in found.collect()} == {e: (f"t{e}", 1.0) for e in range(6)}
    assert found.agg(F.sum("pruned")).first()[0] > 0
    plan = detect.pattern_match(series, points)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan
