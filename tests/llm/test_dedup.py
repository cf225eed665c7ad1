import random

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as ed
from tidemark.llm import near_dedup as nd
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "mine") for i, t in rows], DOCS)


EDGE = [(5, "a b c"), (3, "a  b c "), (4, "abc"), (1, None), (2, ""), (6, " \n\t"), (7, "A b c"), (7, "A b c"), (None, "abc"), (None, "only mine"), (8, "x" * 100_000), (9, "a bc")]


def test_exact_edges(spark):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in ed.dedup(docs(spark, EDGE)).collect()), key=str)
    assert got == sorted(ed.brute_force(EDGE), key=str)
    kept = ed.dedup(docs(spark, EDGE)).where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == 6


def test_exact_drop(spark):
    left = ed.drop_copies(docs(spark, EDGE))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest"]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, [3, 6, 7, None, 8, 9]))
    assert ed.drop_copies(docs(spark, [])).count() == 0 and ed.dedup(docs(spark, [])).count() == 0


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    assert ed.dedup(docs(spark, rows)).where("kept").count() == 201


def test_cuckoo_filter_grows_and_deletes():
    keys = [random.Random(i).randbytes(32) for i in range(5000)]
    shard = ed.LiveShard()
    for k in keys:
        shard.insert(k)
    assert shard.filter.log2_buckets > 8 and all(shard.find(k) for k in keys)
    for k in keys[::2]:
        assert shard.delete(k)
    assert not shard.delete(keys[0])
    assert all((shard.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    again = ed.CuckooFilter.from_bytes(shard.filter.log2_buckets, shard.filter.to_bytes())
    assert all(again.contains(k) for k in keys[1::2])
    assert sum(again.contains(random.Random(10_000 + i).randbytes(32)) for i in range(1, 3000)) < 20


def test_index_batches(spark):
    def batch(rows):
        return spark.createDataFrame([(t, op) for t, op in rows], "text string, op string").select(F.unhex(F.sha2("text", 256)).alias("digest"), "op")

    index = ed.update_index(None, batch([(f"t{i}", "+") for i in range(300)]), 4)
    index = ed.update_index(index, batch([(f"t{i}", "-") for i in range(100)] + [("t299", "+"), ("new", "+")]), 4).cache()
    found = {bytes(r.digest): r.live for r in ed.probe_index(index, batch([(f"t{i}", "?") for i in range(302)] + [("new", "?")]), 4).collect()}
    assert sum(found.values()) == 201 and len(found) == 303


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def mutate(rng, ws, share):
    return [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in ws]


def test_near_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(120)]
    base = words(rng, 150)
    rows += [(1000 + i, " ".join(mutate(rng, base, rng.choice([0.01, 0.04, 0.06, 0.1])))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, "One"), (2003, "one "), (2004, "a b"), (2005, " \t"), (2006, "A B"), (2007, " ".join(words(rng, 30_000)))]
    rng.shuffle(rows)
    for k in (2, 5):
        got = sorted(tuple(r) for r in nd.near_dedup(docs(spark, rows), k).collect())
        assert got == sorted(nd.brute_force(rows, k))


def test_near_edges(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "q")]
    got = nd.near_dedup(docs(spark, rows), 5).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, None, True), (2, 1, False), (1, 1, True), (1, 1, True), (3, 3, True)], key=str)
    assert nd.near_dedup(docs(spark, []), 5).count() == 0
    left = nd.drop_near_copies(docs(spark, rows))
    assert left.count() == 4 and left.columns[-1] == "digest"


def test_near_links_of_an_id_with_several_texts(spark):
    """Each text of a repeated id has its links, in any order of the rows, and the id joins them."""
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(5, a), (5, b), (7, a + ["x"]), (8, b + ["y"]), (9, words(rng, 20)), (9, words(rng, 20)), (None, a)]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = {(r.doc_id, r.component_id) for r in nd.near_dedup(docs(spark, [(i, " ".join(w)) for i, w in order]).repartition(3), 2).collect()}
        assert got == {(5, 5), (7, 5), (8, 5), (9, 9), (None, None)}
    got = {(r.doc_id, r.component_id) for r in nd.near_dedup(docs(spark, [(3 if i == 7 else i, " ".join(w)) for i, w in rows]), 2).collect()}
    assert got == {(3, 3), (5, 3), (8, 3), (9, 9), (None, None)}


def test_near_large_bucket_in_parts(spark, monkeypatch):
    """Hot buckets, clouds of components and blocks in several parts give what one part gives."""
    for name, value in (("SPLIT", 20), ("BLOCK", 16), ("BLOCK_ELEMENTS", 2_000)):
        monkeypatch.setattr(nd, name, value)
    rng = random.Random(6)
    base = words(rng, 150)
    rows = [(i, " ".join(mutate(rng, base, rng.choice([0.02, 0.06, 0.1, 0.12])))) for i in range(160)]
    assert sorted(tuple(r) for r in nd.near_dedup(docs(spark, rows), 2).collect()) == sorted(nd.brute_force(rows, 2))


def test_sketch_agreement_follows_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = np.concatenate((both, rng.integers(0, 2**63, 100, dtype=np.uint64))), np.concatenate((both, rng.integers(0, 2**63, 100, dtype=np.uint64)))
    s = nd.sketches([np.unique(a), np.unique(b), both[:1]], 200)
    assert s.shape == (3, 200) and (s != nd._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
