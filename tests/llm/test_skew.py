"""What was lost or landed in one task before: items without an id, ids with several texts, equal rows, many sources."""

import random

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing
from tidemark.operators.chunks import numbered

ITEM = "A train leaves Berlin at 9 with Anna on board and runs 60 miles towards the coast before it stops for water"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, pii string")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_items_without_an_id_decontaminate(spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, 20) + ". " + ITEM + ". " + prose(rng, 9), "s"), (2, ITEM.replace("60", "75").replace("Anna", "Maria"), "s"), (3, prose(rng, 60), "s")]
    items = spark.createDataFrame([(None, ITEM), (None, prose(rng, 30)), (7, ITEM), (None, None)], "item_id long, text string")
    for few in (10**9, 0):
        found = {r.doc_id: (r.item_ids, r.n_items) for r in decontaminate.leaks(docs(spark, rows), items, few).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items")).collect()}
        assert found == {1: ([7], 2), 2: ([7], 2)}
    unnamed = decontaminate.contaminated(docs(spark, rows), items.where("item_id is null")).collect()
    assert {(r.doc_id, tuple(r.item_ids), r.n_items) for r in unnamed} == {(1, (), 1), (2, (), 1)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), items.where("item_id is null")).collect()] == [3]


def test_texts_of_one_id_are_judged_by_themselves(spark):
    first, last = " ".join(ITEM.split()[:9]), " ".join(ITEM.split()[12:])
    other = ITEM.replace("60", "75").replace("Anna", "Maria")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    whole = {r.doc_id for r in decontaminate.leaks(docs(spark, [(1, first, "s"), (1, last, "s"), (2, other, "s"), (2, ITEM, "s"), (2, "x " + other, "s")]), items).collect()}
    assert whole == {2}


def test_windows_that_many_places_hold_are_joined_in_parts(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, f"{ITEM} {prose(rng, 12)}") for i in range(5)], "item_id long, text string")
    rows = docs(spark, [(i, f"{prose(rng, 5)}. {ITEM} {prose(rng, 3)}", "s") for i in range(60)])
    want = sorted(map(tuple, decontaminate.leaks(rows, items).collect()))
    assert len(want) == 300 and sorted(map(tuple, decontaminate.leaks(rows, items, few=0, hot=7).collect())) == want


def test_equal_rows_go_round_the_parts(spark):
    rows = docs(spark, [(1, "same words here", "hot")] * 3000 + [(i, f"own {i} " * (i % 5), f"s{i % 4}") for i in range(3000)]).repartition(6)
    dealt = mixing._dealt(mixing._measured(rows, "doc_id").where("size > 0"), 100)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert dealt.count() == 5400 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = sorted(map(str, mixing.mix(rows, block=16, part=100).collect()))
    assert sorted(map(str, mixing.mix(rows.repartition(3, "text"), block=16, part=100).collect())) == got


def test_many_sources_are_not_summed_in_one_task(spark):
    rng = random.Random(2)
    for sizes in ([("b", 10), ("a", 1000), (None, 7), ("c", 0), ("é", 300)], [(f"s{i:03d}", rng.choice((0, 1, 5, 9999, 70))) for i in range(200)] + [(None, 5)], [("a", 0)]):
        table = spark.createDataFrame(sizes, "source string, source_size long")
        few, many = mixing.targets(table), mixing.targets(table, few=0)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        want = mixing.brute_targets(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in many.collect())
        one, other = (mixing.planned(t, 16, few=f).select("rank", "slots", "first_slot") for t, f in ((few, 10), (many, 0)))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert numbered(table, ["source"], ["source_size"]).count() == 1
