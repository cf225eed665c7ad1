"""The log behind the stream sinks: appends, merges, compaction, crashes, races, stored marks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators.series import newer_than
from tidemark.sources.keyed_log import KeyedLog

ROWS = "day string, id long, v long"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def log(spark, folder, **more):
    return KeyedLog(spark, str(folder), ["day", "id"], F.col("day"), **more)


def held(t):
    return sorted((tuple(r) for r in t.table().collect()), key=str)


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for n in names if n.endswith(".parquet")}


def test_a_small_batch_adds_files_and_rewrites_none(spark, tmp_path):
    t = log(spark, tmp_path, bound=3)
    first = spark.range(20_000).selectExpr("concat('d', id % 30) as day", "id", "id as v")
    assert t.append(first, "w", 0)
    t.compact()
    before = files(tmp_path)
    assert t.append(first.where("id % 200 = 7").selectExpr("day", "id", "-v as v"), "w", 1)
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) > len(before)
    assert sorted(r.v for r in t.table().where("v < 0").collect()) == sorted(-i for i in range(20_000) if i % 200 == 7)
    assert t.table().count() == 20_000


def test_batches_merge_as_an_upsert_would_through_compactions(spark, tmp_path):
    dice, want, t = random.Random(1), {}, log(spark, tmp_path, bound=4)
    for number in range(11):
        batch = {(None if dice.random() < 0.1 else f"d{dice.randrange(4)}", dice.randrange(20)): dice.randrange(1000) for _ in range(15)}
        want |= batch
        assert t.append(table(spark, [(*k, v) for k, v in batch.items()]), "w", number)
        assert sorted(held(t), key=str) == sorted([(*k, v) for k, v in want.items()], key=str)
        assert len(t.version()[1]["log"]) < 4
    size = len(files(tmp_path))
    t.compact()
    t.compact()
    assert len(files(tmp_path)) <= size and t.vacuum() == 0 and sorted(held(t), key=str) == sorted([(*k, v) for k, v in want.items()], key=str)


def test_an_order_decides_over_all_batches(spark, tmp_path):
    t = log(spark, tmp_path, order=["v"], bound=3)
    for number, rows in enumerate(([("a", 1, 5), ("a", 1, 7), ("a", 2, 1)], [("a", 1, 6), ("a", 2, 3)], [("a", 1, 2)], [("a", 1, 9), ("b", 1, 0)])):
        t.append(table(spark, rows), "w", number)
    assert held(t) == [("a", 1, 9), ("a", 2, 3), ("b", 1, 0)]


def test_replays_and_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    t = log(spark, tmp_path)
    t.append(table(spark, [("a", 1, 1)]), "w", 0)
    assert not t.append(table(spark, [("a", 1, 99)]), "w", 0)

    def crash(self, number, state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_commit", crash)
        with pytest.raises(OSError):
            t.append(table(spark, [("a", 1, 2), ("a", 2, 2)]), "w", 1)
    again = log(spark, tmp_path)  # after a restart
    assert held(again) == [("a", 1, 1)]
    assert again.append(table(spark, [("a", 1, 2), ("a", 2, 2)]), "w", 1) and held(again) == [("a", 1, 2), ("a", 2, 2)]
    assert again.vacuum() == 1 and held(again) == [("a", 1, 2), ("a", 2, 2)]
    assert again.append(table(spark, []), "w", 2) and held(again) == [("a", 1, 2), ("a", 2, 2)]


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    one, other, commit = log(spark, tmp_path), log(spark, tmp_path), KeyedLog._commit
    one.append(table(spark, [("a", 0, 0)]), "x", 0)
    meets = [lambda: other.append(table(spark, [("a", 2, 2)]), "y", 0), lambda: other.compact()]

    def late(self, number, state):
        if self is one and meets:
            meets.pop(0)()
        return commit(self, number, state)

    monkeypatch.setattr(KeyedLog, "_commit", late)
    assert one.append(table(spark, [("a", 1, 1)]), "x", 1)
    assert held(one) == held(other) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2)] and not meets
    assert not session.create_file(spark, f"{tmp_path}/versions/{1:020d}.json", "{}")


def test_marks_advance_with_their_rows(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, f"2024-01-{1 + i // 4:02d} 00:00:00") for i in range(60)], "id long, source string, at string").withColumn("at", F.col("at").cast("timestamp"))
    t = KeyedLog(spark, str(tmp_path), ["id"])

    def upto(day, log=t):
        def choose(marks):
            known = spark.createDataFrame(list(marks.items()), "source string, last string").withColumn("last", F.col("last").cast("timestamp"))
            return newer_than(events.where((F.col("at") < day) & F.col("source").isNotNull()), known, "source", "at")

        return choose

    ids = lambda: sorted(r.id for r in t.table(events.schema).collect())
    want = lambda day: sorted(r.id for r in events.where((F.col("at") < day) & F.col("source").isNotNull()).collect())
    assert t.ingest(upto("2024-01-05"), "source", "at") and ids() == want("2024-01-05")
    assert not t.ingest(upto("2024-01-05"), "source", "at")
    commit = KeyedLog._commit
    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.ingest(upto("2024-01-08"), "source", "at")
    assert t.marks()["s1"] == "2024-01-04 00:00:00" and ids() == want("2024-01-05")
    other = KeyedLog(spark, str(tmp_path), ["id"])
    meets = [1]

    def late(self, number, state):
        if self is t and meets:
            meets.pop()
            other.ingest(upto("2024-01-09"), "source", "at")
        return commit(self, number, state)

    monkeypatch.setattr(KeyedLog, "_commit", late)
    assert t.ingest(upto("2024-01-12"), "source", "at") and ids() == want("2024-01-12") and t.marks() == {"s0": "2024-01-10 00:00:00", "s1": "2024-01-11 00:00:00", "s2": "2024-01-11 00:00:00"}
    assert t._read(t.version()[1], [f"upsert_attempt={e['attempt']}/{p}" for e in t.version()[1]["log"] for p in e["parts"]]).count() == len(want("2024-01-12"))  # no row twice
