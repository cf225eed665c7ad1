"""Each stage of the pipeline against brute force on its own input, and the whole run."""

from tests.llm.test_other import leaks_by_hand
from tidemark.llm import exact_dedup, near_dedup

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    first = stage["quality classifier"](spark, docs, sf_dir).cache()
    kept = rows(first)
    assert first.columns == docs.columns and all(i in kept for i, q in labels.items() if q == 1) and not any(i in kept for i, q in labels.items() if q == 0)
    second = stage["exact dedup"](spark, first, sf_dir).cache()
    best = {k for _, k, _, _ in exact_dedup.brute_force(list(kept.items()))}
    assert set(rows(second)) == best and second.columns == docs.columns
    third = stage["MinHash near-dedup"](spark, second, sf_dir).cache()
    assert set(rows(third)) == {i for i, _, _, k in near_dedup.brute_force(list(rows(second).items()), 5) if k}
    fourth = stage["benchmark decontamination"](spark, third, sf_dir).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(rows(third)) - set(rows(fourth)) == {d for d, _ in leaks_by_hand(list(rows(third).items()), bench)} and fourth.columns == docs.columns
    last = stage["mixing sources to target weights"](spark, fourth, sf_dir).collect()
    assert {r.doc_id for r in last} == set(rows(fourth)) and all(0 <= r.taken <= 2 * r.size for r in last)
    spark.conf.set(corpus_pipeline.MIX_DIR, str(tmp_path / "blocks"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))
    spark.conf.unset(corpus_pipeline.MIX_DIR)
    blocks = spark.read.parquet(str(tmp_path / "blocks")).collect()
    assert sum(r.words for r in blocks) == sum(r.taken for r in last) == sum(len(r.text.split()) for r in blocks)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, sf_dir).count() == 0


def test_stages_on_nulls_ties_repeated_rows_and_clashing_columns(spark, sf_dir):
    names = "doc_id long, text string, lang string, source string, n_chars long, Score double, doc string, row long, digest string, hash string, gone_id long, part int"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    good = "The old house by the river stands empty now. Nobody has come to see it since the spring, and the garden is full of weeds. A man from the town said that it will be sold."
    rows = [(1, good), (1, good), (2, good + " Soon."), (3, good.replace(" ", "  ")), (4, None), (5, ""), (6, " \n"), (None, good), (None, "only mine here"), (7, good + "\n" + item), (8, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, None, None if i == 2 else "s", None, 1.0, "mine", 7, "mine", None, 9, 3) for i, t in rows], names)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    kept = stage["quality classifier"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and set(ids(kept)) <= {str(i) for i, _ in rows} and {r.Score for r in kept.collect()} <= {1.0}
    second = stage["exact dedup"](spark, docs, sf_dir)
    assert second.columns == docs.columns and ids(second) == sorted(map(str, [3, 2, 6, None, 7, 8]))
    third = stage["MinHash near-dedup"](spark, docs, sf_dir)
    assert third.columns == docs.columns and [i for i in ids(third) if i in ("1", "2", "3")] == ["1", "1"] and ids(third).count("None") == 2 and {"4", "5", "6", "8"} <= set(ids(third))
    fourth = stage["benchmark decontamination"](spark, docs, sf_dir)
    assert fourth.columns == docs.columns and ids(fourth) == sorted(str(i) for i, _ in rows if i != 7)
    last = stage["mixing sources to target weights"](spark, docs, sf_dir).collect()
    assert len(last) == len(rows) and all(r.taken <= 2 * r.size for r in last) and all(r.size == 0 == r.taken for r in last if r.doc_id in (4, 5, 6))
