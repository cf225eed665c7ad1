"""Loads whose texts stay where they are, and facts counted before they are keyed."""

import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import dims
from tidemark.queries import facts as fq
from tidemark.queries.text import LEXICON, lexicon


def shuffled(df, column):
    """The exchanges of the plan, broadcasts aside, that ``column`` goes through."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in re.findall(r"\bExchange .*\n.*", plan) if column in x]


def test_texts_are_scored_where_they_are(spark, sf_dir):
    plan = fq.text_signals(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scores_of_an_expression_are_those_of_the_join(spark):
    texts = ["The end of the and que", "", None, "nothing here", "THE,the;that\n le-les 12 die", "é the étude of", " ... "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    joined = {r.k: (r.compound, r.pos, r.neg) for r in tx.lexicon_sentiment(rows, "k", "t", lexicon(spark)).collect()}
    signed = lambda sign: [t for t, v in LEXICON.items() if v * sign > 0]
    told = rows.select("k", tx.compound_of(F.col("t"), LEXICON), tx.share_of(F.col("t"), signed(1)), tx.share_of(F.col("t"), signed(-1))).collect()
    assert {r[0]: tuple(r[1:]) for r in told} == joined and len(joined) == len(texts)


def test_a_load_compares_keys_and_shuffles_no_texts(spark):
    rows = [(d, f"u{i % 7}" if i % 5 else None, f"text {i}") for d in (1, 2, None, 3) for i in range(20)]
    new = spark.createDataFrame(rows, "time_id long, url string, raw_text string")
    key = lambda r: (r[0], r[1])
    some = [[r for r in rows if r[0] == 2], [r for r in rows if r[0] != 3 and r[1] in ("u1", None)], [r for r in rows if r[0] in (1, None)], [], rows]
    for loaded in some:
        known = spark.createDataFrame(loaded, new.schema)
        want = sorted(r[2] + str(r[0]) for r in rows if key(r) not in {key(x) for x in loaded})
        for few in (100, 1):
            got = dims.fresh_facts(new, known, ["time_id", "url"], few)
            assert sorted(r.raw_text + str(r.time_id) for r in got.collect()) == want
        assert not shuffled(dims.fresh_facts(new, known, ["time_id", "url"]), "raw_text")


def test_keys_are_looked_up_without_a_shuffle_of_the_rows(spark):
    known = spark.createDataFrame([(f"s{i}", i) for i in range(9)], "name string, entity_id long").repartition(3)
    rows = spark.range(40).select(F.concat(F.lit("s"), (F.col("id") % 9).cast("string")).alias("n"), F.current_date().alias("d"), F.col("id").cast("string").alias("raw_text"))
    times = rows.select(F.col("d").alias("date"), F.lit(5).alias("time_id")).distinct()
    found = dims.lookup(rows, "n", known, "name", "entity_id")
    assert found.count() == 40 and not shuffled(found, "raw_text")
    facts = dims.star_facts(rows, F.col("d"), F.col("n"), times, known)
    assert facts.count() == 40 and not shuffled(facts, "raw_text")


def test_signals_without_a_value_are_left_out_without_a_lambda(spark):
    from tidemark.sources import adapters as ad

    base = spark.createDataFrame(
        [("2024-01-01", "b", "t", 3, 10.0, 4.0, 2), ("2024-01-01", "b", "t", 3, 10.0, 0.0, None), ("2024-01-02", "b", None, None, None, None, 5)],
        "date string, p_brand string, p_type string, s_nationkey int, l_extendedprice double, l_quantity double, l_linenumber int",
    )
    got = ad.reality_signals(base)
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    values = sorted((r.date[-1], r.entity_type, r.name or "", r.metric_name, r.metric_value) for r in got.collect())
    first = [("1", "ai_model", "nation-3", "model_downloads_delta", v) for v in (-25.0, -21.0)] + [("1", "company", "b", "stock_price", 3.0)] + [("1", "company", "b", "trading_volume", v) for v in (0.0, 4.0)]
    assert values == [*first, ("1", "software", "t", "github_forks_delta", -1.0), *[("1", "software", "t", "github_stars_delta", v) for v in (-25.0, -21.0)], ("2", "software", "", "github_forks_delta", 2.0)]


def test_facts_are_counted_once_before_they_are_keyed(spark, sf_dir):
    from tidemark.queries import warehouse
    from tidemark.sources import adapters as ad

    keys = ["time_id", "entity_id", "metric_name"]
    rows = ad.reality_facts(spark, sf_dir)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in re.findall(r"\bExchange hashpartitioning\([^)]*", plan) if "name#" in x or "date#" in x]
    counted = sorted(map(tuple, ad.reality_counts(spark, sf_dir).select(*keys, "n").collect()))
    assert counted == sorted(map(tuple, rows.groupBy(*keys).count().collect()))
    assert "l_shipdate" not in warehouse.anti_new_facts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
