import os
import re

from pyspark.sql import functions as F

from tidemark.llm import common, mixing, pii

DOCS = "doc_id long, text string, source string, pii string, size long, row long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, t, s in rows], DOCS)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}

TEXTS = [
    None,
    "",
    "mail a.b@c.d.e_f@g.h, x@y and é@b.co z@b..c",
    "1.2.3.4 01.002.0003.4 256.1.1.1 1.2.3.4.5.6.7.8 00000000000000000000255.1.1.1 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 1 4111111111111111",
    "+1 (017) 555-7713 +1 2 +123456789012345678 +4420794609580 ++49 30 901820",
    "my iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, GB83WEST12345698765432",
    "ssn: 123-45-6789 but with none of those words in reach before it, 987-65-4321",
    "😀 a@b.cd 😀 10.0.0.1",
    "a@b.cc_d@e.ff" * 50,
    "a." * 20_000 + "@" + "b." * 20_000 + "c",
    "1" * 50_000 + " " + "1 " * 20_000,
]


def test_pii_base_spans(spark):
    got = {r.doc_id: r for r in pii.digest(docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])).collect()}
    for i, t in enumerate(TEXTS):
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        for kind, (rx, ok) in PLAIN.items():
            want = [(str(m.start()), str(m.end())) for m in re.finditer(rx, t or "") if ok(m.group())]
            assert [(a, b) for k, a, b in spans if k == kind] == want, (i, kind)
            assert getattr(got[i], f"n_{kind}") == len(want)
    extra = {i: [x for x in got[i].spans.split(",") if x.startswith(("iban", "ssn"))] for i in got}
    assert extra[6] == ["iban:8:35", "iban:40:62"] and extra[7] == ["ssn:5:16"]


def test_pii_iban_ends_where_its_country_says(spark):
    """A word, capital or digit after the IBAN is not read as part of it."""
    texts = {
        "DE89 3704 0044 0532 0130 00 Please": "iban:0:27", "GB82WEST12345698765432 BIC WESTGB2L": "iban:0:22", "DE89370400440532013000 I": "iban:0:22", "pay NO9386011117947 7 of 9": "iban:4:19",
        "DE89370400440532013000 DE89370400440532013000": "iban:0:22,iban:23:45", "DE893704004405320130001": "", "DE89 3704 0044 0532 0130 01": "", "ZZ89370400440532013000": "", "MT84MALT011000012345MTLCAST001S": "iban:0:31",
    }
    got = pii.digest(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [",".join(x for x in r.spans.split(",") if x.startswith("iban")) for r in got] == list(texts.values())


def test_pii_redacts(spark):
    out = pii.redact(docs(spark, [(1, "to a@b.cd or 4111 1111 1111 1111.", "s"), (2, None, "s")])).collect()
    assert [r.text for r in out] == ["to [email] or [card].", ""] and {r.pii for r in out} == {"x"}


def test_targets_against_resharing(spark):
    for sizes in ([("b", 10), ("a", 1000), (None, 7), ("c", 0), ("é", 300)], [("a", 5)], [("a", 0)], [(f"s{i}", 2**i) for i in range(12)]):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        want = mixing.brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select("id", mixing.swap_or_not(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
        rows = rows.withColumn("back", mixing.swap_or_not(F.col("p"), F.lit(n), F.lit(5), inverse=True)).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert sum(r.p == r.id for r in rows) < 20


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000, None, "a"), (1001, "x y z", None), (1002, " \t\n", "a"), (1003, "v " * 30_000, "s1"), (1004, "q q", "tiny"), (None, "n n n", "tiny"), (1005, "q q", "tiny"), (1005, "q q", "tiny")]
    got = mixing.mix(docs(spark, rows), block=16, part=50).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total = by.setdefault((r.source_size, r.target), [0, 0])
        total[0] += r.size
        total[1] += r.taken
    for (size, target), (n, taken) in by.items():
        assert n == size and abs(taken - target) <= 1
    for other in (docs(spark, rows).repartition(1), docs(spark, rows).repartition(7, "text")):
        assert sorted(map(str, mixing.mix(other, block=16, part=50).collect())) == sorted(map(str, got))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_shards_are_full_and_counts_add_up(spark):
    sources = spark.createDataFrame([("a", 40_000, 0, 80_000.0), ("b", 90_001, 1, 45_000.4)], "source string, source_size long, rank int, target double")
    plan = mixing.planned(sources, 16)
    drawn = mixing.draw(plan).cache()
    dealt = mixing.slots(plan, drawn, 16).cache()
    assert dealt.select("shard", "place").distinct().count() == dealt.count()
    sizes = [r["count"] for r in dealt.groupBy("shard").count().orderBy("shard").collect()]
    assert set(sizes[:-1]) == {mixing.SHARD}
    taken = {r.rank: r.t for r in dealt.groupBy("rank").agg({"take": "sum"}).withColumnRenamed("sum(take)", "t").collect()}
    assert taken == {0: 80_000, 1: 45_000}
    first = {r["rank"]: r.n for r in drawn.where("shard = 0").collect()}
    assert abs(first[0] / mixing.SHARD - 80 / 125) < 0.06
    assert {(r.shard, r["rank"]): r["count"] for r in dealt.groupBy("shard", "rank").count().collect()} == {(r.shard, r["rank"]): r.n for r in drawn.collect()}
    fewer = mixing.slots(plan, drawn.where("shard <> 1"), 16)
    assert fewer.count() == dealt.count() - mixing.SHARD


def test_mix_follows_the_draw(spark, monkeypatch):
    """What a document gives is what the drawn shards take: other draws, other shards; fewer, fewer words."""
    rows = docs(spark, [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}") for i in range(400)])
    whole = {r.doc_id: r for r in mixing.mix(rows, block=4, part=50).collect()}
    real = mixing.draw
    monkeypatch.setattr(mixing, "draw", lambda plan: real(plan).where("shard <> 0"))
    less = {r.doc_id: r for r in mixing.mix(rows, block=4, part=50).collect()}
    assert sum(r.taken for r in less.values()) < sum(r.taken for r in whole.values()) and all(r.first_shard != 0 for r in less.values())


def test_mix_by_hand(spark):
    """The words that each document gives, counted by taking every drawn slot in turn from streams of words."""
    rows = [(i, "w " * (1 + i * 5 % 40), f"s{i % 3}") for i in range(60)]
    block, d = 8, docs(spark, rows)
    sizes = {i: 1 + i * 5 % 40 for i, _, _ in rows}
    got = {r.doc_id: r.taken for r in mixing.mix(d, block=block, part=10).collect()}
    marks = {r.doc_id: r.mark for r in mixing._measured(d, "doc_id").collect()}
    by_source = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in ("s0", "s1", "s2")}
    plan = mixing.planned(mixing.targets(spark.createDataFrame(list(by_source.items()), "source string, source_size long")), block)
    dealt = mixing.slots(plan, mixing.draw(plan), block).collect()
    want = dict.fromkeys(got, 0)
    for rank, source in enumerate(sorted(by_source)):
        ids = sorted((i for i, _, s in rows if s == source), key=lambda i: (marks[i] % (len(rows) // 10), marks[i]))
        stream = [i for i in ids for _ in range(sizes[i])]
        for r in dealt:
            if r["rank"] == rank:
                for i in stream[r.block * block : r.block * block + r.take]:
                    want[i] += 1
    assert got == want


def test_mixed_blocks_are_what_mix_counts(spark):
    """The output holds every dealt slot once, with the words of its block, and the totals of mix() are its sums."""
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(1 + i * 7 % 90)), f"s{i % 3}") for i in range(120)] + [(500, None, "s1"), (501, " \t", None)]
    d = docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(d, block=16, part=50).collect()}
    out = mixing.mixed_blocks(d, block=16, part=50).collect()
    words = [w for r in out for w in r.text.split()]
    assert {i: sum(w.startswith(f"d{i}w") for w in words) for i, _, _ in rows} == taken
    places = sorted(r.shard * mixing.SHARD + r.place for r in out)
    assert places == list(range(len(out))) and all(r.words == len(r.text.split()) <= 16 for r in out)
    sides = mixing.mixed(d, block=16, part=50).groupBy("shard", "place", "source", "block").sum("words").collect()
    assert sorted(map(tuple, sides)) == sorted((r.shard, r.place, r.source, r.block, r.words) for r in out)
    source = {i: s for i, _, s in rows}
    assert all(source[int(w[1:].split("w")[0])] == r.source for r in out for w in r.text.split())


def test_written_mix_holds_the_blocks_and_gives_the_totals(spark, tmp_path):
    """Long texts over many blocks, words of several scripts, no words at all: the folder holds the blocks, whole shards in order."""
    rows = [(i, "\t ".join(f"ä{i}x{k}" for k in range(1 + i * 7 % 90)), f"s{i % 3}") for i in range(60)] + [(500, None, "s1"), (501, "", None), (502, "long " * 5_000, "s0"), (502, "long " * 5_000, "s0")]
    d, folder = docs(spark, rows), str(tmp_path / "mix")
    totals = mixing.written_mix(d, folder, block=16, part=50).collect()
    assert sorted(map(str, totals)) == sorted(map(str, mixing.mix(d, block=16, part=50).collect()))
    held, blocks = spark.read.parquet(folder), mixing.mixed_blocks(d, block=16, part=50)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, blocks.collect()))
    assert held.groupBy().sum("words").first()[0] == sum(r.taken for r in totals) == sum(len(r.text.split()) for r in held.collect())
    assert held.select("shard", F.input_file_name().alias("file")).distinct().groupBy("shard").count().where("count > 1").isEmpty()
    mixing.written_mix(docs(spark, []), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).isEmpty()


def test_scratch_removes_what_is_written_inside(spark):
    d = docs(spark, [(1, "a b", "s")])
    outside = common.cut(d)
    with common.scratch(spark):
        inside = common.cut(d)
        gone = inside.inputFiles()[0].split("/")[-2]
        assert inside.count() == 1
    assert outside.count() == 1
    store = outside.inputFiles()[0].split("/")[-2]
    kept = os.listdir(common.shared_dir(spark).removeprefix("file:"))
    assert store in kept and gone not in kept
