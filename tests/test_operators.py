"""Hand-made edge cases and invariants."""

import datetime as dt
import math
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import detect, dims, quality, series, serving
from tidemark.plans import features, indices, refresh
from tidemark.sources import staging

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(200)]


def daily(spark, values, name="x"):
    return spark.createDataFrame([(1, D[i], v) for i, v in enumerate(values)], f"entity_id int, date date, {name} double")


def test_windows_on_short_and_zero_series(spark):
    rows = daily(spark, [5.0]).select(features.rolling("x", 7).alias("a"), features.volatility("x").alias("v"), features.change("x", 7).alias("m")).first()
    assert (rows.a, rows.v, rows.m) == (5.0, None, None)
    rows = daily(spark, [0.0] * 7 + [3.0]).select("date", features.change("x", 7).alias("m")).orderBy("date").collect()
    assert rows[-1].m is None


def combined(spark, hype, reality):
    cols = {c: 0.0 for c in ("reddit_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score", "github_stars_delta", "hf_downloads_delta", "hype_reality_gap")}
    rows = spark.createDataFrame([(i + 1, D[i], 1, "a", "company", h, r) for i, (h, r) in enumerate(zip(hype, reality))], "time_id long, date date, entity_id long, entity_name string, entity_type string, multi_source_hype_intensity double, reality_strength_score double")
    return rows.withColumns({c: F.lit(v) for c, v in cols.items()})


def test_flat_entity_scores_50(spark):
    got = indices.entity_bubble(combined(spark, [2.0] * 5, [1.0, 2.0, 3.0, 0.0, 1.0])).orderBy("date").collect()
    assert {r.hype_score for r in got} == {50.0} and got[2].reality_score == 100.0 and got[3].hype_reality_ratio == 0.0


def test_two_time_ids_of_a_date_keep_the_larger(spark):
    rows = spark.createDataFrame([(1, D[0], 0.1), (2, D[0], 0.2), (3, D[1], 0.3)], "time_id long, date date, hype_index double")
    assert sorted((r.time_id, r.hype_index) for r in indices.latest_per_date(rows).collect()) == [(2, 0.2), (3, 0.3)]


def test_facts_fan_out_by_name_unless_typed(spark):
    times = spark.createDataFrame([(1, D[0])], "time_id long, date date")
    entities = spark.createDataFrame([(1, "a", "company"), (2, "a", "software")], "entity_id long, name string, entity_type string")
    rows = spark.createDataFrame([(D[0], "a"), (None, "a"), (D[0], None)], "d date, n string")
    load = lambda kind=None: dims.star_facts(rows, F.col("d"), F.col("n"), times, entities, entity_type=kind).count()
    assert (load(), load("software")) == (2, 1)


def test_reload_adds_nothing(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    assert dims.unseen(spark.createDataFrame([("a", 2), ("b", 3), (None, 4)], "k string, v int"), known, ["k"]).collect()[0].k == "b"


def test_a_second_load_of_facts_adds_nothing_nulls_included(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (None, "b", 3.0)], "time_id long, url string, v double")
    path = f"{tmp_path}/facts"
    for batch in (facts.limit(0), facts.where("v = 2"), facts, facts):
        dims.append_facts(batch, path, ["time_id", "url"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0]


def test_lookup_fails_on_unknown_and_null(spark):
    known = spark.createDataFrame([("a", 4), ("a", 2), ("b", 3)], "ticker string, entity_id long")
    rows = lambda *t: dims.lookup(spark.createDataFrame([(x,) for x in t], "t string"), "t", known, "ticker", "entity_id")
    assert {(r.t, r.entity_id) for r in rows("a", "b", "a").collect()} == {("a", 2), ("b", 3)}
    assert rows().count() == 0
    for bad in ("c", None):
        with pytest.raises(Exception, match="no entity_id for t"):
            rows("a", bad).collect()


def test_recent_papers_and_last_month(spark):
    rows = spark.createDataFrame([(D[0], {"x": 1, "y": 5}), (D[3], {}), (None, None)], "d date, m map<string,long>")
    assert [r.d for r in tx.recent(rows, "d", str(D[5]), 2).collect()] == [D[3]]
    assert sorted(r[0] for r in rows.select(tx.last_of_map(F.col("m"))).collect()) == [0, 0, 5]


def test_all_entities_together_are_an_entity(spark):
    rows = events(spark, [1, 2, 3, 4, 50, 6], [1, 1, 2, 1, 1, 2])
    alone = detect.asof_alerts(rows).drop("entity_id", "contributing_factors").collect()
    both = detect.asof_alerts(detect.include_global(rows, rows)).drop("contributing_factors")
    assert alone and sorted(both.where(F.col("entity_id") == detect.EVERYONE).drop("entity_id").collect()) == sorted(alone)
    assert both.count() == 2 * len(alone)


def events(spark, hype, reality, entity=1):
    return spark.createDataFrame([(entity, D[i], float(h), float(r)) for i, (h, r) in enumerate(zip(hype, reality))], "entity_id long, date date, hype double, reality double")


def reference_scores(hype, reality):
    def scale(x):
        q = np.percentile(x, [25, 50, 75])
        return (x - q[1]) / ((q[2] - q[0]) or 1)

    d = pd.Series(scale(np.array(hype, float)) - scale(np.array(reality, float)))
    a = d.diff().diff().ewm(span=7).mean().fillna(0.0)
    z = lambda s: (s - s.mean()) / s.std(ddof=0) if s.std(ddof=0) > 1e-9 else s * 0
    return z(d).iloc[-1], z(a).iloc[-1]


def test_scores_as_of_each_day_equal_scores_from_scratch(spark):
    rng = random.Random(5)
    hype, reality = [rng.randrange(6) for _ in range(40)], [rng.randrange(4) for _ in range(40)]
    got = {r.n: (r.divergence_z or 0, r.acceleration_z or 0) for r in detect.asof_scores(events(spark, hype, reality)).collect()}
    assert sorted(got) == list(range(5, 41))
    for n, (z, a) in got.items():
        assert np.allclose((z, a), reference_scores(hype[:n], reality[:n]), atol=1e-9)


def test_few_rows_and_constant_series_raise_no_alert(spark):
    assert detect.alerts(events(spark, [1, 9, 1, 9], [0] * 4)).count() == 0
    assert detect.alerts(events(spark, [1] * 9, [1] * 9)).count() == 0
    assert detect.alerts(events(spark, [1] * 9 + [50], [1] * 10)).first().alert_level == "watch"


@pytest.mark.parametrize(("p", "want"), [(0.9, "critical"), (0.7, "warning"), (0.0, "watch")])
def test_levels(spark, p, want):
    assert spark.range(1).select(detect.level(F.lit(3.1), F.lit(0.0), F.lit(p)).alias("l")).first().l == want


def test_levels_at_thresholds(spark):
    assert spark.range(1).select(detect.level(F.lit(1.5), F.lit(2.0), F.lit(0.0)).alias("l")).first().l is None


def test_pattern_match(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=12), rng.normal(size=9)
    cost = np.full((13, 10), np.inf)
    cost[0, 0] = 0
    za, zb = (a - a.mean()) / a.std(ddof=1), (b - b.mean()) / b.std(ddof=1)
    for i in range(1, 13):
        for j in range(1, 10):
            cost[i, j] = (za[i - 1] - zb[j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    one = daily(spark, a.tolist(), "divergence")
    shape = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(b)], "template string, pos int, value double")
    assert math.isclose(detect.pattern_match(one, shape).first().pattern, 1 / (1 + math.sqrt(cost[12, 9])), rel_tol=1e-9)
    assert detect.pattern_match(one, shape.limit(0)).count() == 0


def test_changepoints_find_the_steps(spark):
    x = [0.0] * 20 + [5.0] * 15 + [1.0] * 25
    got = {r.date for r in detect.changepoints(daily(spark, x, "divergence"), 2).collect()}
    assert got == {D[19], D[34]}


def test_lead_lag_prefers_the_leading_series(spark):
    rng = np.random.default_rng(1)
    lead = rng.normal(size=150)
    noise, target = rng.normal(size=150), np.concatenate(([0, 0], lead[:-2])) + rng.normal(size=150) * 0.3
    rows = spark.createDataFrame([(1, D[i], float(lead[i]), float(noise[i]), float(target[i])) for i in range(150)], "entity_id long, date date, lead double, noise double, target double")
    got = {r.indicator: r.score for r in detect.lead_lag(rows, ["lead", "noise"], "target").collect()}
    assert got["lead"] > 0.999999 and got["noise"] < 0.999


def test_chi_square_tail():
    for df, x, p in ((1, 3.841, 0.05), (2, 5.991, 0.05), (3, 7.815, 0.05), (5, 11.07, 0.05), (4, 9.488, 0.05)):
        assert abs(detect.chi2_tail(x, df) - p) < 2e-4


def test_save_alerts_leaves_out_known_and_nan(spark):
    cols = "timestamp timestamp, entity_id long, alert_level string, confidence double"
    t = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([(t, 1, "watch", float("nan")), (t, 1, "watch", 0.0), (t, 2, "watch", 0.5)], cols)
    got = detect.save_alerts(new, spark.createDataFrame([(t, 2, "watch", 0.1)], cols)).collect()
    assert [(r.entity_id, r.confidence) for r in got] == [(1, 0.0)]


def test_news_without_content_or_mention_is_dropped(spark):
    rows = spark.createDataFrame([("", " ", "x"), ("He said so", "", "TechDaily"), ("nothing", "here", "x"), (None, None, None)], "title string, description string, source string").withColumns({"sentiment": F.lit(-0.5), "pos": F.lit(0.1), "neg": F.lit(0.4)})
    got = tx.news_features(rows, ["AI"]).collect()
    assert [(r.title, r.ai_mentions, r.impact_score, r.sentiment_confidence) for r in got] == [("He said so", 1, 1.5, 0.4)]


def test_post_with_score_minus_one_has_no_rate(spark):
    rows = spark.createDataFrame([(1704067200, "t", "x", -1, 2, 0.5), (1, "old", "x", 1, 1, 0.5)], "created_utc long, title string, selftext string, score long, num_comments long, sentiment double")
    got = tx.post_features(rows).collect()
    assert [(r.engagement_score, r.engagement_rate) for r in got] == [(0.0, None)]


def test_revenue(spark):
    texts = ["Revenue was $1,234.5 million", "our revenue: 2 billion", "revenue , only", "none", None, "REVENUE 7"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.revenue(F.col("t")).alias("v")).collect()]
    assert got == [1.2345e9, 2e9, None, None, None, 7.0]


def test_mixed_case_term_is_tested_as_written(spark):
    rows = spark.createDataFrame([("mobile AI on-device", 2)], "abstract string, n_authors int")
    got = tx.paper_features(rows).first()
    assert got.has_edge_ai and not tx.paper_features(rows, {"edge_ai": ["mobile AI"]}, ["x"], {"a": ["b"]}).first().has_edge_ai


def test_factors(spark):
    texts = ["{\"divergence\": 1.5, \"acceleration\": 2, \"pattern_similarity\": 0}", "{'divergence': np.float64(1.5), 'acceleration': -2.0}", "a 1 b -2.5 c 3", "garbage " * 10]
    got = [tuple(r.p) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.parse_factors(F.col("t")).alias("p")).collect()]
    assert got == [(1.5, 2.0, 0.0, None), (1.5, -2.0, 0.0, None), (1.0, -2.5, 3.0, None), (None, None, None, ("garbage " * 10)[:50])]


def test_snapshot_deltas(spark):
    rows = spark.createDataFrame([("r", D[0], 1000, 100, 2.0, 0, 100), ("r", D[1], 1100, 120, 3.0, 5, 150), ("r", D[2], 1000, 120, 4.0, 5, 150), (None, D[0], 5, 5, 5.0, 5, 5)], "name string, date date, stars long, forks long, activity_score double, downloads long, likes long")
    got = {(r.name, r.date): r for r in series.repo_deltas(rows).collect()}
    assert (got["r", D[1]].stars_delta, got["r", D[1]].forks_delta, got["r", D[1]].momentum_score) == (100, 20, 1.0)
    assert got["r", D[2]].momentum_score == -1.0 and got["r", D[0]].stars_delta == 1000 and got[None, D[0]].stars_delta == 0
    models = {r.date: r for r in series.model_deltas(rows.where("name = 'r'")).collect()}
    assert math.isclose(models[D[1]].trending_score, 5 / 1 * 0.6 + 50 / 100 * 0.4)


def test_gap_of_nine_days_counts_once(spark):
    rows = spark.createDataFrame([(D[0],), (D[9],), (D[10],)], "date date")
    assert [r.gap_days for r in quality.date_gaps(rows, "date", 7).collect()] == [9]


def test_assign_keys_equals_row_number(spark):
    rows = spark.createDataFrame([(i * 7919 % 503, i) for i in range(2000)], "a int, b int")
    got = dims.assign_keys(rows, "k", ["a", "b"], 5).orderBy("k").collect()
    assert [r.k for r in got] == list(range(6, 2006)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_prices(spark):
    wide = spark.createDataFrame([(D[0], 1.0, 10.0, 2.0, 20.0), (D[1], None, None, 3.0, 30.0)], ["Date", "('Close', 'A')", "('Volume', 'A')", "Close_B", "Volume_B"])
    assert sorted((str(r.date), r.ticker, r.close) for r in staging.prices_to_long(wide).collect()) == [("2024-01-01", "A", 1.0), ("2024-01-01", "B", 2.0), ("2024-01-02", "B", 3.0)]
    mixed = spark.createDataFrame([(D[0], "B", 1.0, 2.0)], ["Date", "Ticker", "Close_A", "Close_B"])
    assert [(r.ticker, r.close) for r in staging.prices_to_long(mixed).collect()] == [("B", 2.0)]
    plain = spark.createDataFrame([(D[0], "A", 1.0)], ["date", "ticker", "close"])
    assert staging.prices_to_long(plain).first().close == 1.0 and staging.prices_to_long(spark.createDataFrame([(D[0], 1)], ["date", "x"])).count() == 0


def test_index_does_not_depend_on_partitioning(spark):
    rng = random.Random(1)
    names = [c for c, _ in (*indices.HYPE_NORMS.values(), *indices.REALITY_NORMS.values())]
    extra = ["github_trending_score", "hf_trending_score", "stock_price", "github_stars_delta", "github_forks_delta", "hf_downloads_delta"]
    columns = sorted({*names, *extra})
    rows = [(t, D[t], e, f"e{e}", ("company", "software", "ai_model", "research")[e % 4], *[rng.randrange(-8, 9) / 8 for _ in columns]) for t in range(20) for e in range(8)]
    df = spark.createDataFrame(rows, ["time_id", "date", "entity_id", "entity_name", "entity_type", *columns])
    show = lambda d: [(r.date, round(r.hype_index, 9), round(r.reality_index, 9)) for r in indices.both_indices(d).orderBy("date").collect()]
    assert show(df) == show(df.repartition(7).orderBy(F.rand(3)))
    both = indices.hype_index(df).join(indices.reality_index(df), "date").orderBy("date").collect()
    assert [(r.date, round(r.hype_index, 9), round(r.reality_index, 9)) for r in both] == show(df)
    exact = indices.hype_index(df, str(D[9])).orderBy("date").collect()
    assert [(r.date, round(r.hype_index, 9)) for r in exact] == [x[:2] for x in show(df)[10:]]


def test_recent_alerts_without_names(spark):
    a = spark.createDataFrame([(dt.datetime(2024, 1, 9), 1, "watch", 1.0, 0.0, 0.0, 0.5), (dt.datetime(2024, 1, 9), 2, "watch", 1.0, None, 0.0, 0.7), (dt.datetime(2023, 1, 9), 1, "watch", 1.0, 0.0, 0.0, 0.5)], "timestamp timestamp, entity_id long, alert_level string, divergence_score double, acceleration_score double, pattern_score double, confidence double")
    got = serving.recent_alerts(a, spark.createDataFrame([(9, "z")], "entity_id long, name string"), "2024-01-10").collect()
    assert [(r.entity_name, r.confidence) for r in got] == [("Unknown", 0.7)]


def test_streams_take_arrivals_in_parts_and_rows_without_a_day(spark):
    from pyspark.sql import functions as F

    from tidemark.queries import series
    from tidemark.streaming import jobs

    rows = spark.range(0, 80, 1, 4).selectExpr("id", "case when id % 8 > 0 then date_add(date'2024-01-10', cast(id % 8 as int)) end as day")
    seen = []

    class Sink(jobs.Upserts):
        def __call__(self, batch, batch_id):
            seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))
            super().__call__(batch, batch_id)

    got = series._streamed(spark, rows, "day", lambda s: s, ["id"], "append", Sink)
    assert sorted(r.id for r in got.collect()) == list(range(80))
    assert seen == [(40, 4), (40, 4)]


def test_stream_sink_survives_a_restart_and_a_replay(spark, tmp_path):
    from tidemark.streaming import jobs

    folder, schema = str(tmp_path), "name long, date date, stars long, forks long, activity_score double"
    day = dt.date.fromisoformat
    arrivals = [
        [(1, day("2024-01-01"), 10, 1, 2.0), (2, day("2024-01-01"), 5, 0, 1.0)],
        [(1, day("2024-01-03"), 15, 1, 1.0), (1, day("2024-01-02"), 12, 2, 3.0), (2, None, 9, 9, 9.0)],
        [(2, day("2024-01-01"), 99, 9, 9.0), (2, day("2024-01-05"), 4, 0, 2.0)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        sink = jobs.Upserts(spark, f"{folder}/out", ["name", "date"], F.col("date"))
        jobs.run_once(jobs.stream_deltas(jobs.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 9)), sink, "append", f"{folder}/state")
    out = sorted(tuple(r) for r in jobs.Upserts(spark, f"{folder}/out", ["name", "date"]).table(spark.createDataFrame([], jobs.DELTAS).schema).collect())
    assert [(n, str(d), s, f, round(c, 6)) for n, d, s, f, c, _ in out] == [(1, "2024-01-01", 10, 1, 2.0), (1, "2024-01-02", 2, 1, 1.0), (1, "2024-01-03", 3, -1, -2.0), (2, "2024-01-01", 5, 0, 1.0), (2, "2024-01-05", -1, 0, 1.0)]
    batch = spark.createDataFrame([(1, day("2024-01-02"), 7, 7, 7.0, 7.0)], jobs.DELTAS)
    for _ in range(2):
        jobs.Upserts(spark, f"{folder}/out", ["name", "date"], F.col("date"))(batch, 3)
    again = jobs.Upserts(spark, f"{folder}/out", ["name", "date"]).table(batch.schema)
    assert again.count() == 5 and again.where("stars_delta = 7").count() == 1


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    from tidemark.streaming import jobs

    folder, schema = str(tmp_path), "key string, ts timestamp, v int"
    at = dt.datetime.fromisoformat
    for rows in ([("a", at("2024-01-01T00:00:00"), 1), ("a", at("2024-01-01T01:00:00"), 2)], [("a", at("2024-01-01T02:00:00"), 3), ("b", at("2024-01-01T02:00:00"), 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.first_by_key(jobs.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 9), ["key"], "ts")
        jobs.run_once(stream, jobs.Upserts(spark, f"{folder}/out", ["key", "v"]), "append", f"{folder}/state")
    got = jobs.Upserts(spark, f"{folder}/out", ["key", "v"]).table(spark.createDataFrame([], schema).schema).collect()
    assert sorted(r.key for r in got) == ["a", "b"] and {r.v for r in got if r.key == "b"} == {4} and all(r.v < 3 for r in got if r.key == "a")


def test_refresh_in_steps_keeps_the_state_of_a_full_run_and_survives_a_crash(spark, tmp_path):
    dice = random.Random(3)
    keys = [(i + 1, D[i], e, f"e{e}", kind) for i in range(50) for e, kind in ((1, "company"), (2, "software"), (3, "ai_model")) if (i + e) % 4]
    kinds = "time_id long, date date, entity_id long, entity_name string, entity_type string"
    values = lambda n: [float(dice.randint(1, 9)) for _ in range(n)]
    hype = spark.createDataFrame([(*k, *values(5), 1, 1, 1, 1, 1) for k in keys], f"{kinds}, " + ", ".join(f"{c} double" for c, _ in features.HYPE.values()) + ", " + ", ".join(f"{n} long" for _, n in features.HYPE.values()))
    reality = spark.createDataFrame([(*k, *values(5)) for k in keys], f"{kinds}, " + ", ".join(f"{c} double" for c in features.REALITY.values()))
    store, rows = str(tmp_path), lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert refresh.refresh(spark, store, hype.limit(0), reality.limit(0)).count() == 0
    for last in (39, 44, 49):
        refresh.refresh(spark, store, *[d.where(F.col("date") <= F.lit(D[last])) for d in (hype, reality)])
    assert refresh.refresh(spark, store, hype, reality).count() == 0
    combined = features.combined_features(features.hype_features(hype), features.reality_features(reality))
    state = lambda name: spark.read.parquet(f"{store}/state/{D[49]}/{name}")
    assert rows(state("sums")) == rows(refresh.weight_sums(combined))
    assert rows(state("hype")) == sorted(r for e in (1, 2, 3) for r in rows(hype.where(f"entity_id = {e}"))[-30:])
    whole = rows(refresh.stored(spark, store))
    assert [r[0] for r in whole] == D[:50]
    shutil.rmtree(f"{store}/bubble/until={D[49]}")  # as if the last refresh had stopped before its commit
    refresh.refresh(spark, store, hype, reality)
    assert rows(refresh.stored(spark, store)) == whole
