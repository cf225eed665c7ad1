"""Prefix tries, spelling variants and repeated windows: brute force on small tables, SQL on the given ones."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as pt
from tidemark.llm import queries
from tidemark.llm import spelling as sp
from tidemark.llm import substring_dedup as sd

TURNS = "conv_id long, turn long, role string, text string, depth int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, begins string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_spelling", "op13_substring_dedup"])
def test_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == sorted(want.select(", ".join(got.columns)).fetchall(), key=str)


def talk(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TURNS)


EDGE_TURNS = [
    (20, 1, "user", "hello there"), (20, 2, "bot", "hi"), (20, 3, "user", "bye now then"), (21, 1, "user", "hello there"), (21, 2, "bot", "hi"), (22, 1, None, None), (22, None, "user", "first"),
    (23, 5, "b", "tie"), (23, 5, "a", "tie"), (23, 5, "a", "tie"), (24, 1, "user", ""), (45, 1, "user", "hello there"), (45, 2, "x", "y " * 30_000), (None, 1, "user", "lost"), (-3, 1, "user", "minus"), (0, 1, "", ""),
    (40, 1, "user", "hello there"),
]


def test_trie_edges(spark):
    assert rows_of(pt.digest(talk(spark, EDGE_TURNS))) == sorted(pt.brute_force(EDGE_TURNS), key=str)
    assert pt.digest(talk(spark, [])).count() == 0


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rng = random.Random(3)
    rows = [(7, t, "user", f"w{t % 5} v") for t in range(90)] + [(8, t, "user", f"w{t % 5} v") for t in range(70)] + [(9, t, "user", f"w{t % 5} v" if t < 50 else "other") for t in range(60)]
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(3)] + [(200 + c, t, "user", f"x{rng.randrange(3)}") for c in range(40) for t in range(rng.randrange(1, 7))]
    want = sorted(pt.brute_force(rows), key=str)
    for block, shard in ((8, 20), (512, 20_000)):
        turns, ids = pt.rebuilt(pt.cut(pt.placed(talk(spark, rows))))
        assert rows_of(pt.trie_nodes(turns, ids, block, shard)) == want


def test_double_array_holds_what_went_in():
    rng = random.Random(5)
    sequences = [np.array([rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))], np.int64) for _ in range(500)]
    trie, levels = pt.build(sequences)
    seen = {}
    for depth, nodes in enumerate(levels, 1):
        for s, node in zip(sequences, nodes):
            if len(s) >= depth:
                assert seen.setdefault(tuple(s[:depth]), int(node)) == node and trie.check[node] == (seen[tuple(s[: depth - 1])] if depth > 1 else pt.ROOT)
    assert len(set(seen.values())) == len(seen)  # no two prefixes share a slot
    assert len(trie.check) < 3 * len(seen)


def test_spelling_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(250)] + ["aaaaa", "aaaab", "aaaaaa", "baaaa", "abcde", "bacde", "edcba", "ÿÿÿÿÿ", "éàéàé"]
    counts = {w: rng.choice((3, 4, 5, 9, 20, 50)) for w in base}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(sp.spelling_groups(words)) == sorted(sp.brute_force(counts), key=str)
    assert sp.spelling_groups(words.limit(0)).count() == 0


def test_spelling_signatures_miss_no_near_word():
    rng, signatures = random.Random(2), sp.Signatures()
    for _ in range(2_000):
        a = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 12)))
        i, c = rng.randrange(len(a)), rng.choice("abcxyz")
        b = rng.choice((a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]))
        of_a, of_b = set(signatures.of(a)), set(signatures.of(b))
        if a != b:
            assert sp.near(a, b)
            assert any((r, s) in of_b for r, s in of_a if r == 0) if len(a) == len(b) else {s for r, s in of_a if r == 1 + (len(a) > len(b))} & {s for r, s in of_b if r == 1 + (len(b) > len(a))}


def test_spelling_chain_and_edges(spark):
    words = [("aaaaa", 100), ("aaaab", 40), ("aaabb", 18), ("aabbb", 8), ("abbbb", 3), ("zzzzz", 3)]
    got = {r.word: (r.form, r.root, r.n_near) for r in sp.spelling_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abbbb"] == ("aabbb", "aaaaa", 1) and got["zzzzz"] == (None, "zzzzz", 0) and got["aaaaa"] == (None, "aaaaa", 1)
    rows = [(1, "Ärger ÄRGER ärger abcdé ABCDé abcdé x2abcde-fghij", "", "", 0, "", ""), (2, None, "", "", 0, "", ""), (None, "fghij fghij " * 2, "", "", 0, "", ""), (3, "", "", "", 0, "", "")]
    got = {r.word: r.n for r in sp.frequent(sp.runs(spark.createDataFrame(rows, DOCS)).select(F.col("run").alias("word"))).collect()}
    assert got == {"abcdé": 3, "fghij": 5}
    assert sp.digest(spark.createDataFrame([], DOCS)).count() == 0


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "own", "own") for i, t in rows], DOCS)


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_windows_edges(spark):
    p = passage(1, 40)
    rows = [(5, p), (3, f"x\t{p}\n\ny " + passage(2, 20)), (9, passage(2, 20) + " " + p), (1, None), (2, ""), (4, " \n "), (6, passage(1, 12)), (7, "a " * 500), (8, "a " * 20), (8, "a " * 20), (None, p), (3, p), (10, passage(3, 30_000)), (11, "é ü ß " * 5)]
    for bucket in (sd.BUCKET, 50):
        got = sorted(map(tuple, sd.repeats(docs(spark, rows), bucket).collect()), key=str)
        assert got or bucket
    known = [r for r in rows if r[0] is not None]
    assert rows_of(sd.digest(docs(spark, known))) == sorted(sd.brute_force(known), key=str)
    lost = [r for r in sd.digest(docs(spark, rows)).collect() if r.doc_id is None]
    assert [r.n_removed for r in lost] == [0]
    assert sd.digest(docs(spark, [])).count() == 0
    left = sd.drop_repeats(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "mark", "begins"] and left.count() == len(rows)
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept[1] is None and kept[4] == " \n " and kept[5] == "" and kept[9] == ""


def test_windows_of_a_hot_passage_in_parts(spark):
    p, rows = passage(1, 30), []
    for i in range(400):
        rows.append((i * 7 % 400, f"{passage(i + 10, 9)} {p} {passage(1000 + i, 9)}" if i % 3 else f"{' '.join(p.split()[: 13 + i % 17])} {passage(i + 10, 30)}"))
    want = sorted(sd.brute_force(rows), key=str)
    assert rows_of(sd.digest(docs(spark, rows).repartition(7))) == want
    spread = docs(spark, rows).repartition(20)
    packed = sd.PACKED
    assert packed > 1 and rows_of(sd.digest(spread)) == want


def test_super_kmers_share_minimisers():
    rng = np.random.default_rng(4)
    words, doc = [b"w%d" % i for i in rng.integers(0, 5, 3_000)], np.sort(rng.integers(0, 40, 3_000))
    line, at = sd.Line(b" ".join(words)), np.arange(len(words))
    assert [line.text[a:b] for a, b in zip(line.begin, line.end)] == words
    runs = line.hashes(at[: len(at) - sd.M + 1], at[sd.M - 1 :])
    first, n, least = sd.super_kmers(runs, doc)
    windows = {}
    for a, m, x in zip(first, n, least):
        for i in range(a, a + m):
            assert doc[i] == doc[i + sd.K - 1]
            assert windows.setdefault(tuple(words[i : i + sd.K]), x) == x  # equal windows, equal minimisers
    assert n.sum() == (doc[: -sd.K + 1] == doc[sd.K - 1 :]).sum() and n.max() <= sd.LONGEST


def test_windows_of_equal_hashes_are_told_apart():
    rng = np.random.default_rng(6)
    line = sd.Line(b" ".join(b"w%d" % i for i in rng.integers(0, 3, 400)))
    at = np.arange(398)
    begin, end = line.begin[at], line.end[at + 2]
    pieces = [line.text[a:b] for a, b in zip(begin, end)]
    for hashed in (line.hashes(at, at + 2), line.hashes(at, at + 2) % np.uint64(4), np.zeros(398, np.uint64)):
        rank, order = sd.exact_ranks(line.text, begin, end, hashed)
        assert len(set(zip(rank.tolist(), pieces))) == len(set(pieces)) == len(set(rank.tolist()))
        assert (np.diff(rank[order]) >= 0).all()
