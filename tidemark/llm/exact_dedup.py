"""Exact deduplication over a sharded cuckoo-filter index of live digests.

The index is a table with one row per shard: the filter's slots and the digests that live in it. A digest always
belongs to the shard that its hash names, so batches of inserts and deletes touch each shard independently and a
shard stays of bounded size, whatever the corpus. A filter hit is only a hint: it is verified against the digests
stored in the shard. A filter that overflows is rebuilt at twice the size from those stored digests.

Edge cases: a null text counts as empty; texts of white space only equal the empty text; a null ``doc_id`` is kept
only if no row of its group has one; of rows that repeat the same ``doc_id`` and text one row stays; an empty table
gives an empty result; further columns of the input are ignored by :func:`dedup` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, shards_for, text_of

SLOTS = 4
MAX_KICKS = 200
#: Rows of one group are pre-aggregated and joined in this many parts, so that no key is hot.
SALTS = 64
#: Digests (with their parts) in one shard, on average.
PER_SHARD = 50_000

INDEX_SCHEMA = "shard int, log2_buckets int, slots binary, digests array<binary>"


class CuckooFilter:
    """A filter of 16-bit fingerprints, four to a bucket, with insertion and deletion."""

    def __init__(self, log2_buckets: int = 4, slots: np.ndarray | None = None):
        self.log2_buckets = log2_buckets
        self.mask = (1 << log2_buckets) - 1
        self.slots = np.zeros(SLOTS << log2_buckets, np.uint16).tolist() if slots is None else slots.tolist()

    @classmethod
    def of(cls, digests: Iterable[bytes], log2_buckets: int = 4) -> CuckooFilter:
        """A filter that holds all of ``digests``, grown as far as they need."""
        keys = list(digests)
        while SLOTS << log2_buckets < len(keys) * 1.1:
            log2_buckets += 1
        while True:
            new = cls(log2_buckets)
            if all(new.insert(key) for key in keys):
                return new
            log2_buckets += 1

    @classmethod
    def from_bytes(cls, log2_buckets: int, data: bytes) -> CuckooFilter:
        return cls(log2_buckets, np.frombuffer(data, np.uint16))

    def to_bytes(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _put(self, bucket: int, mark: int) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[slot]:
                self.slots[slot] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if the filter is full; its slots may then lack one fingerprint, and it has to be rebuilt."""
        mark, first, second = self._places(digest)
        if self._put(first, mark) or self._put(second, mark):
            return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def contains(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        slots = self.slots
        return mark in slots[first * SLOTS : first * SLOTS + SLOTS] or mark in slots[second * SLOTS : second * SLOTS + SLOTS]

    def delete(self, digest: bytes) -> bool:
        """Remove one fingerprint of a digest that was inserted."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[slot] == mark:
                    self.slots[slot] = 0
                    return True
        return False


class LiveShard:
    """One shard of the index: the filter, and the live digests with what is known of each."""

    def __init__(self, row: pd.Series | None = None):
        self.live: dict[bytes, object] = {}
        self.filter = CuckooFilter()
        if row is not None:
            self.live = {bytes(d): True for d in row["digests"]}
            self.filter = CuckooFilter.from_bytes(int(row["log2_buckets"]), bytes(row["slots"]))

    def find(self, digest: bytes) -> object | None:
        """What is stored for a live digest; the filter answers for most that are not live."""
        return self.live.get(digest) if self.filter.contains(digest) else None

    def insert(self, digest: bytes, value: object = True) -> None:
        self.live[digest] = value
        if not self.filter.insert(digest):
            self.filter = CuckooFilter.of(self.live, self.filter.log2_buckets + 1)

    def delete(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        del self.live[digest]
        return self.filter.delete(digest)

    def frame(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "log2_buckets": [self.filter.log2_buckets], "slots": [self.filter.to_bytes()], "digests": [list(self.live)]})


def normalised(column: str = "text"):
    """The text without white space; texts with equal results are copies."""
    return F.translate(text_of(column), SPACE_CHARS, "")


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("digest", F.unhex(F.sha2(normalised(text), 256)))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def update_index(index: DataFrame | None, batch: DataFrame, shards: int) -> DataFrame:
    """Apply a batch of (digest, op '+' or '-') to the index; deletes come first, and both are idempotent."""
    spark = batch.sparkSession
    index = spark.createDataFrame([], INDEX_SCHEMA) if index is None else index
    changes = batch.select("digest", "op").distinct().select(shard_of(shards), "digest", "op")

    def apply(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = LiveShard(old.iloc[0] if len(old) else None)
        for digest in new.loc[new["op"] == "-", "digest"]:
            shard.delete(bytes(digest))
        for digest in new.loc[new["op"] == "+", "digest"]:
            if shard.find(bytes(digest)) is None:
                shard.insert(bytes(digest))
        return shard.frame(int(key[0]))

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, INDEX_SCHEMA)


def probe_index(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """(digest, live) for the distinct digests of a batch; a filter hit counts only if the digest is stored."""
    asked = batch.select("digest").distinct().select(shard_of(shards), "digest")

    def ask(_: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = LiveShard(old.iloc[0] if len(old) else None)
        return pd.DataFrame({"digest": new["digest"], "live": [shard.find(bytes(d)) is not None for d in new["digest"]]})

    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(ask, "digest binary, live boolean")


def _groups(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Insert the parts of a shard one after the other; a part that hits joins the group of the stored digest."""
    shard, parts = LiveShard(), []
    for frame in frames:
        digests = [bytes(d) for d in frame["digest"]]
        parts.append((digests, frame["salt"].to_numpy()))
        for digest, n, row in zip(digests, frame["n"], zip(frame["shorter"], frame["no_id"], frame["best_id"], frame["best_row"])):
            group = shard.find(digest)
            if group is None:
                shard.insert(digest, [n, row])
            else:
                group[0] += n
                group[1] = min(group[1], row)
    for digests, salt in parts:
        found = [shard.live[d] for d in digests]
        yield pd.DataFrame({
            "digest": digests, "salt": salt, "group_size": [g[0] for g in found],
            "keep_id": pd.array([None if g[1][1] else g[1][2] for g in found], "Int64"), "keep_row": [g[1][3] for g in found],
        })


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points stays, then that of the smallest id. Text is read once; what
    is shuffled is a digest and a few numbers per row.
    """
    return _decided(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def _decided(docs: DataFrame) -> DataFrame:
    keys = cut(
        with_digest(docs.withColumn("row", F.monotonically_increasing_id())).select(
            "row", "doc_id", "digest", (-F.length(text_of())).alias("shorter"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
        )
    )
    shards = shards_for(keys.count(), PER_SHARD, docs.sparkSession)
    best = F.min(F.struct("shorter", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row"))
    parts = keys.groupBy("digest", "salt").agg(F.count("*").alias("n"), best.alias("best"))
    groups = (
        parts.select(shard_of(shards), "digest", "salt", "n", "best.shorter", "best.no_id", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"))
        .groupBy("shard")
        .applyInPandas(_groups, "digest binary, salt int, group_size long, keep_id long, keep_row long")
    )
    return keys.join(groups, ["digest", "salt"]).withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without copies, with all their columns; repeated rows of one ``doc_id`` leave one row.

    Only ids that lose a row are joined back to the texts. An id that keeps one row and loses another (repeated
    rows, or one id with several texts) is settled by (id, digest).
    """
    decided = _decided(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))).select("doc_id", "digest", "kept")
    losing = cut(decided.groupBy("doc_id").agg(F.count_if("kept").alias("kept_rows"), F.count("*").alias("all_rows")).where("kept_rows < all_rows"))
    whole = docs.select(F.struct("*").alias("doc"))
    rest = whole.join(losing.select(F.col("doc_id").alias("lost_id")), F.col("doc.doc_id").eqNullSafe(F.col("lost_id")), "left_anti")
    mixed = losing.where("kept_rows > 0").select(F.col("doc_id").alias("mixed_id"))
    if mixed.isEmpty():
        return rest.select("doc.*")
    pairs = decided.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    some = whole.join(mixed, F.col("doc.doc_id").eqNullSafe(F.col("mixed_id")), "left_semi").select("doc", F.unhex(F.sha2(normalised("doc.text"), 256)).alias("digest"))
    some = some.join(pairs, F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    one = some.withColumn("id", F.col("doc.doc_id")).dropDuplicates(["id", "digest"])
    return rest.unionByName(one.select("doc")).select("doc.*")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The result of :func:`dedup` for a small fixture, by plain Python."""
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in SPACE_CHARS), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        norm = "".join(c for c in text or "" if c not in SPACE_CHARS)
        _, none, best = min(groups[norm])
        out.append((doc_id, None if none else best, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out
