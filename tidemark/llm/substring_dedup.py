"""Substring deduplication by super-k-mers: repeated windows of words go from all documents but the first.

A window is ``K`` consecutive words of one document. Each window has a minimiser, the least hash of its runs of ``M``
words; consecutive windows that share one make a super-k-mer, and its words travel as one packed string to the
minimiser's bucket. Equal windows have equal minimisers, so they meet. A bucket sorts its windows by a hash and compares
those of equal hashes word by word, which counts equal windows exactly. A window is repeated if a document with a smaller
id holds it, too; every word in a repeated window goes. Hashes of runs of words come from sums over a task's bytes, so no
Python code runs per word.

A first pass counts the windows of each bucket. A bucket with more than twice its share is cut into parts by packed
string: a part settles what it sees, and sends the windows that its smallest id holds on to an exact comparison over all
parts, by their words. So neither a passage that a third of all documents hold nor a common run of words lands in a task.

Edge cases: null and empty texts, and texts of fewer than ``K`` words, lose nothing; a row without an id is nobody's
predecessor and loses nothing; repeated rows of one id are judged alike, as none has a smaller id; an id with several
texts counts as one document; an empty table gives an empty result; further columns, with whatever names, are ignored by
:func:`digest` and kept by :func:`drop_repeats`; very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, side, text_of
from .decontaminate import powers
from .near_dedup import mix

K, M = 13, 3
#: Windows of a bucket, on average.
BUCKET = 150_000
#: Words that are cut together, and the most windows of a super-k-mer and super-k-mers of a packed string.
CHUNK, LONGEST, PACKED = 400_000, 256, 2_000
#: Characters of text for a window, to guess the number of buckets.
CHARS = 6


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size, out = 1, g
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


class Line:
    """Words joined by single spaces: where each begins and ends, and hashes of runs of them.

    Sums over some bytes at a time give a code for each word, sums over the codes a hash for each run.
    """

    def __init__(self, text: bytes):
        self.text, points = text, np.frombuffer(text, np.uint8)
        spaces = np.nonzero(points == 32)[0]
        self.begin, self.end = np.concatenate(([0], spaces + 1)), np.append(spaces, len(points))
        codes, first = np.empty(len(self.begin), np.uint64), 0
        with np.errstate(over="ignore"):
            while first < len(codes):
                low = self.begin[first]
                last = max(first + 1, int(np.searchsorted(self.end, low + BYTES, "right")))
                own, a, b = points[low : self.end[last - 1]], self.begin[first:last] - low, self.end[first:last] - low
                base, back = powers(len(own))
                sums = np.zeros(len(own) + 1, np.uint64)
                np.cumsum(_VALUES[own] * base, out=sums[1:])
                codes[first:last] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
                first = last
            base, self.back = powers(len(codes))
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * base, out=self.sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the runs from the words ``first`` to the words ``last``."""
        with np.errstate(over="ignore"):
            return mix((self.sums[last + 1] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


#: Bytes that are summed together.
BYTES = 300_000
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def super_kmers(runs: np.ndarray, doc: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of each super-k-mer of words that stand side by side.

    ``runs``: the hash of the ``m`` words from each one on; ``doc``: whose each word is.
    """
    at = np.nonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :])[0]
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    least, whose = _least(runs, k - m + 1)[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[1:] != least[:-1]) | (whose[1:] != whose[:-1])
    first = np.nonzero(new)[0]
    new |= (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % LONGEST == 0
    first = np.nonzero(new)[0]
    return at[first], np.diff(np.append(first, len(at))), least[first]


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Documents of a task, some at a time: their words as one line, and their super-k-mers as ids, marks, first words, places, windows, minimisers."""

    def made(texts: list[bytes], owners: list[tuple]) -> tuple:
        line, (ids, marks, lengths) = Line(b" ".join(texts)), (np.array(x, np.int64) for x in zip(*owners))
        doc, begins = np.repeat(np.arange(len(owners)), lengths), np.cumsum(lengths) - lengths
        words = np.arange(len(doc))
        first, n, least = super_kmers(line.hashes(words[: len(words) - M + 1], words[M - 1 :]), doc)
        of = doc[first]
        return line, ids[of], marks[of], first, first - begins[of], n, mix(least)

    texts, owners, size = [], [], 0
    for frame in frames:
        for doc_id, mark, text in zip(frame["doc_id"], frame["mark"], frame["text"]):
            own = b" ".join(_words(text))
            n = own.count(b" ") + 1
            if n >= K:
                texts.append(own)
                owners.append((doc_id, mark, n))
                size += n
            if size >= CHUNK:
                yield made(texts, owners)
                texts, owners, size = [], [], 0
    if owners:
        yield made(texts, owners)


def _counted(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, n, least in _chunks(frames):
            bucket, at = np.unique(least % np.uint64(buckets), return_inverse=True)
            yield pd.DataFrame({"bucket": bucket.astype(np.int64), "windows": np.bincount(at, n).astype(np.int64)})

    return run


def _packed(buckets: int):
    """Packed strings of a bucket: ids, marks, places and numbers of windows of some super-k-mers, then their words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for line, ids, marks, first, places, n, least in _chunks(frames):
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
            text, begin, end = line.text, line.begin[first].tolist(), line.end[first + n + K - 2].tolist()
            rows = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
                for c in range(a, b, PACKED):
                    some = order[c : min(b, c + PACKED)]
                    head = np.stack((ids[some], marks[some], places[some], n[some]))
                    body = b" ".join([text[begin[i] : end[i]] for i in some.tolist()])
                    rows.append((bucket[order[a]], squeeze(np.int64(len(some)).tobytes() + head.tobytes() + body)))
            yield pd.DataFrame(rows, columns=["bucket", "data"])

    return run


def _unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    rows = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 4 * rows, 8).reshape(4, rows), raw[8 + 32 * rows :]


def exact_ranks(text: bytes, begin: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each piece of ``text``, equal for equal pieces and for no others, and the order in which they stand sorted.

    Pieces are sorted by their hashes; those that share one are compared, and told apart if they differ.
    """
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate(([True], np.diff(hashed[order]) != 0))
    group = np.cumsum(new) - 1
    again = np.nonzero(~new)[0]
    heads = order[np.nonzero(new)[0][group[again]]]
    rest, a, b = order[again], begin.tolist(), end.tolist()
    differ = [g for i, j, g in zip(rest.tolist(), heads.tolist(), group[again].tolist()) if text[a[i] : b[i]] != text[a[j] : b[j]]]
    rank = np.empty(len(hashed), np.int64)
    rank[order] = group
    if differ:
        top = int(group[-1]) + 1
        for g in set(differ):
            known: dict[bytes, int] = {}
            for i in order[group == g].tolist():
                rank[i] = top + known.setdefault(text[a[i] : b[i]], len(known))
            top += len(known)
        order = np.argsort(rank, kind="stable")
    return rank, order


RANGES = "kind int, doc_id long, mark long, begin long, stop long, window binary"


def _judged(frame: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: runs of words in windows that a smaller id of this part holds. Kind 1, of a bucket in parts: the windows of the least id."""
    heads, bodies = zip(*map(_unpacked, frame["data"]))
    ids, marks, places, n = np.concatenate(heads, axis=1)
    line, lengths = Line(b" ".join(bodies)), n + K - 1
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(lengths) - lengths, n) + inside
    begin, end, doc = line.begin[at], line.end[at + K - 1], ids[of]
    rank, order = exact_ranks(line.text, begin, end, line.hashes(at, at + K - 1))
    starts = np.nonzero(np.diff(rank[order], prepend=-1))[0]
    least = np.empty(int(rank.max()) + 1, np.int64)
    least[rank[order][starts]] = np.minimum.reduceat(doc[order], starts)
    gone = doc > least[rank]
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    cuts = np.nonzero(gone[1:] & gone[:-1] & (of[1:] != of[:-1]))[0] + 1  # a run ends with its super-k-mer
    a, b = np.sort(np.concatenate((a, cuts))), np.sort(np.concatenate((b, cuts)))
    place = places[of] + inside
    out = pd.DataFrame({"kind": 0, "doc_id": doc[a], "mark": marks[of[a]], "begin": place[a], "stop": place[b - 1] + K, "window": None})
    if frame["parts"].iloc[0] < 2:
        return out
    kept = np.nonzero(~gone)[0]
    more = pd.DataFrame({"kind": 1, "doc_id": doc[kept], "mark": marks[of[kept]], "begin": place[kept], "stop": place[kept] + K, "window": [line.text[a:b] for a, b in zip(begin[kept].tolist(), end[kept].tolist())]})
    return pd.concat((out, more))


def repeats(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, mark, begins, stops``: the runs of words that go, of each document (and text, by its mark) that loses some."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text")).where("doc_id is not null")
    chars = docs.agg(F.sum(F.length(text_of()))).first()[0] or 0  # one value
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (CHARS * bucket)))
    counts = cut(rows.mapInPandas(_counted(buckets), "bucket long, windows long").groupBy("bucket").agg(F.sum("windows").alias("windows")))
    share = max(1, (counts.agg(F.sum("windows")).first()[0] or 0) // buckets)
    full = counts.where(F.col("windows") > 2 * share).select("bucket", F.ceil(F.col("windows") / share).alias("parts"))
    packed = rows.mapInPandas(_packed(buckets), "bucket long, data binary").join(side(full), "bucket", "left")
    packed = packed.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("data"), F.col("parts")))
    judged = cut(packed.groupBy("bucket", "part").applyInPandas(_judged, RANGES))
    rest = judged.where("kind = 1")
    least = rest.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select(F.col("window").alias("of_window"), "least")
    more = rest.join(least, (F.col("window") == F.col("of_window")) & (F.col("doc_id") > F.col("least")))
    run = F.struct("begin", "stop")
    runs = judged.where("kind = 0").select("doc_id", "mark", "begin", "stop").unionByName(more.select("doc_id", "mark", "begin", "stop"))
    found = runs.groupBy("doc_id", "mark").agg(F.collect_set(run).alias("runs"))
    return found.select("doc_id", "mark", F.col("runs.begin").alias("begins"), F.col("runs.stop").alias("stops"))


def _kept(words: list[bytes], begins, stops) -> list[bytes]:
    if begins is None:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.asarray(begins), 1)
    np.add.at(edge, np.asarray(stops), -1)
    return [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0]]


def _met(docs: DataFrame, found: DataFrame) -> DataFrame:
    own = docs.withColumn("own_id", F.col("doc.doc_id").cast("long")).withColumn("own_mark", F.xxhash64(F.coalesce("doc.text", F.lit(""))))
    return own.join(found, (F.col("own_id") == F.col("doc_id")) & (F.col("own_mark") == F.col("mark")), "left")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, text, begins, stops in zip(frame["own_id"], frame["text"], frame["begins"], frame["stops"]):
            words = _words(text)
            kept = _kept(words, begins, stops)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        yield made.assign(doc_id=made["doc_id"].astype("Int64"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    met = _met(docs.select(F.struct("doc_id", "text").alias("doc")), repeats(docs))
    return met.select("own_id", F.col("doc.text").alias("text"), "begins", "stops").mapInPandas(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words of each text, joined by a space where words went; texts that lose nothing stay as they are."""

    @F.pandas_udf("string")
    def shortened(text: pd.Series, begins: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t if b is None else b" ".join(_kept(_words(t), b, s)).decode("utf-8", "surrogatepass") for t, b, s in zip(text, begins, stops)])

    met = _met(docs.select(F.struct("*").alias("doc")), repeats(docs))
    return met.select(F.col("doc").withField("text", shortened(F.col("doc.text"), "begins", "stops")).alias("doc")).select("doc.*")


def brute_force(rows: list[tuple[int, str | None]], k: int = K) -> list[tuple]:
    """The result of :func:`digest` for a small fixture with ids."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, words in texts:
        for a in range(len(words) - k + 1):
            least[w] = min(i, least.get(w := tuple(words[a : a + k]), i))
    out = []
    for i, words in texts:
        gone = {b for a in range(len(words) - k + 1) if least[tuple(words[a : a + k])] < i for b in range(a, a + k)}
        kept = [w for b, w in enumerate(words) if b not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, word, i, CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS seq FROM w
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), judged AS (
  SELECT doc_id, word, i, seq IS NOT NULL AND min(doc_id) OVER (PARTITION BY seq) < doc_id AS again FROM windows
), covered AS (
  SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM judged
), per AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)
"""
