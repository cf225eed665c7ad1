"""Intervals of any length, quantiles of large groups, long lists of terms, late signals."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import intervals, quantiles
from tidemark.plans import features, indices, refresh

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(200)]


def test_interval_sums_against_brute_force(spark):
    dice = random.Random(1)
    points = [(dice.choice(("a", "a", "a", "b", None)), dice.randrange(-500, 4000), None if dice.random() < 0.1 else float(dice.randrange(9))) for _ in range(600)] + [("a", 77, 1.0)] * 300
    asked = [(i, dice.choice(("a", "b", "c", None)), x := dice.randrange(-600, 4100), x + dice.choice((-5, 0, 1, 9, 10, 63, 700, 5000))) for i in range(150)]
    p, q = spark.createDataFrame(points, "k string, at long, v double"), spark.createDataFrame(asked, "id long, k string, a long, b long")
    want = {}
    for i, k, a, b in asked:
        own = [v for kk, at, v in points if kk == k and k is not None and a <= at <= b]
        held = [v for v in own if v is not None]
        want[i] = (len(own), sum(held) if held else None)
    for width, hot in ((10, 50_000), (10, 40), (1, 7), (10_000, 100)):
        got = intervals.interval_sums(p, q, "k", F.col("at"), F.col("v"), F.col("a"), F.col("b"), width, hot)
        assert got.columns == ["id", "k", "a", "b", "n_points", "total"]
        assert {r.id: (r.n_points, r.total) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_by_passes(spark):
    rng = np.random.default_rng(2)
    groups = {"even": rng.random(3_000), "skewed": np.exp(rng.normal(0, 30, 2_000)), "ties": rng.integers(0, 3, 2_500).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 4.0]), "same": np.full(800, 2.5), "signs": rng.normal(0, 1e-300, 1_500)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for few in (10, 400):
        got = {(r.g, r.prob): r.quantile for r in quantiles.exact_quantiles(df, "g", "x", probs, few).collect()}
        assert len(got) == len(groups) * len(probs)
        assert all(math.isclose(got[k, p], np.quantile(v, p), rel_tol=1e-9, abs_tol=1e-310) for k, v in groups.items() for p in probs)


def test_quartiles_of_ten_million_values(spark):
    df = spark.range(10_000_000).select(F.lit(1).alias("g"), ((F.col("id") * 7_919 % 10_000_019) / 3.0).alias("x"))
    got = {r.prob: r.quantile for r in quantiles.exact_quantiles(df, "g", "x", [0.25, 0.5]).collect()}
    all_values = np.sort((np.arange(10_000_000, dtype=np.int64) * 7_919 % 10_000_019) / 3.0)
    assert all(math.isclose(got[p], np.quantile(all_values, p), rel_tol=1e-12) for p in got) and len(got) == 2


def test_ten_thousand_terms(spark):
    dice = random.Random(3)
    terms = sorted({"".join(dice.choice("abcdé ") for _ in range(dice.randrange(1, 7))) for _ in range(14_000)} - {""})[:10_000]
    texts = ["".join(dice.choice("abcdÉ xyz") for _ in range(dice.randrange(0, 120))) for _ in range(40)] + [None, "", "ABC"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = spark.createDataFrame([(t,) for t in [*terms, *terms[:50], None, ""]], "term string")
    want = {i: sum(t in (x or "").lower() for t in {t.lower() for t in terms}) for i, x in enumerate(texts)}
    for pack in (tx.PACK, 9_000):
        out = tx.term_mentions(df, "text", listed, pack=pack)
        assert out.columns == ["id", "text", "mentions"] and {r.id: r.mentions for r in out.collect()} == want
    few = terms[:40]
    assert {r.id: r.mentions for r in tx.term_mentions(df, "text", spark.createDataFrame([(t,) for t in few], "term string")).collect()} == {r.id: r.m for r in df.select("id", tx.mentions(F.col("text"), few).alias("m")).collect()}
    assert {r.mentions for r in tx.term_mentions(df, "text", listed.limit(0)).collect()} == {0}


def daily_rows(spark, dice, days, entities=((1, "company"), (2, "software"), (3, "ai_model"), (4, "research"))):
    keys = [(i + 1, D[i], e, f"e{e}", kind) for i in range(days) for e, kind in entities if dice.random() < 0.8]
    kinds = "time_id long, date date, entity_id long, entity_name string, entity_type string"
    values = lambda n: [float(dice.randint(1, 9)) for _ in range(n)]
    hype = [(*k, *values(5), *[dice.randint(0, 3) for _ in range(5)]) for k in keys if dice.random() < 0.95]
    reality = [(*k, *values(5)) for k in keys if dice.random() < 0.95]
    make = lambda h, r: (spark.createDataFrame(h, f"{kinds}, " + ", ".join(f"{c} double" for c, _ in features.HYPE.values()) + ", " + ", ".join(f"{n} long" for _, n in features.HYPE.values())), spark.createDataFrame(r, f"{kinds}, " + ", ".join(f"{c} double" for c in features.REALITY.values())))
    return hype, reality, make


def rounded(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_features_and_entity_bubble_in_chunks(spark):
    hype, reality, make = daily_rows(spark, random.Random(5), 130)
    h, r = make(hype, reality)
    plain = features.combined_features(features.hype_features(h), features.reality_features(r))
    for size in (9, 50):
        parts = features.combined_features(features.hype_features(h, size), features.reality_features(r, size))
        assert parts.columns == plain.columns and rounded(parts) == rounded(plain)
        assert rounded(indices.entity_bubble(plain, size)) == rounded(indices.entity_bubble(plain))
    assert indices.entity_bubble(plain, 9).columns == indices.entity_bubble(plain).columns


def test_late_rows_equal_a_full_run(spark, tmp_path):
    dice, store = random.Random(7), str(tmp_path)
    hype, reality, make = daily_rows(spark, dice, 120)
    late = lambda rows: [r for r in rows if r[2] in (1, 3) and r[1] in (D[3], D[40], D[41], D[119])]
    h, r = make([x for x in hype if x not in late(hype)], [x for x in reality if x not in late(reality)])
    keys = lambda *tables: spark.createDataFrame(sorted({(x[2], x[1]) for t in tables for x in t}), "entity_id long, date date")
    refresh.late_refresh(spark, store, h, r, keys(hype, reality), 0)
    full = make(hype, reality)
    changed = [(1, D[60], 4.0)]
    hype2 = [(*x[:5], 4.0, *x[6:]) if (x[2], x[1]) == (1, D[60]) else x for x in hype]
    full = make(hype2, reality)
    dirty = keys(late(hype), late(reality), [x for x in hype2 if (x[2], x[1]) == (1, D[60])])
    for _ in range(2):  # a replay changes nothing
        made = refresh.late_refresh(spark, store, *full, dirty, 1)
    touched = made.select("entity_id", "date").collect()
    assert {t.entity_id for t in touched} == {1, 3} and len(touched) < 0.9 * sum(x[2] in (1, 3) for x in hype) and changed
    whole = features.combined_features(features.hype_features(full[0]), features.reality_features(full[1]))
    assert rounded(refresh.feature_store(spark, store).table().select(*whole.columns)) == rounded(whole)
    assert rounded(refresh.late_bubble(spark, store)) == rounded(indices.bubble_metrics(indices.both_indices(whole)))


def test_large_dimensions_and_repeated_keys_of_a_load(spark, tmp_path):
    from tidemark.operators import dims

    members = spark.createDataFrame([(n, k) for n, k in (("b", 1), ("a", 2), (None, 3), ("c", None), ("a", 1))], "name string, kind int")
    few, many = (sorted(map(tuple, dims.member_keys(members, "id", "name", "kind", few=f).collect())) for f in (10, 2))
    assert few == many and [r[:2] for r in few] == [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)]
    facts = spark.createDataFrame([(1, "a", 1.0, {"x": 1}), (1, "a", 2.0, {"x": 2}), (None, "a", 3.0, {}), (None, "a", 3.0, {}), (2, None, 4.0, None)], "time_id long, url string, v double, more map<string,int>")
    for _ in range(2):
        dims.append_facts(facts, f"{tmp_path}/facts", ["time_id", "url"], one_per_key=True)
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/facts").collect()) == [2.0, 3.0, 4.0]
