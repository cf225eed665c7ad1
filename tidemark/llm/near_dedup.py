"""MinHash near-deduplication by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of ``k`` words. Its sketch is filled in rounds of hashed bin placement:
in round ``i`` every element is thrown into one of ``t`` bins with a value of ``i`` plus a hash; bins keep the
least. From round ``t`` on, round ``t + j`` throws every element into bin ``j``, so after ``2 t`` rounds at the most
each coordinate is filled; usually a few rounds do. Coordinates are cut into bands, whose hashes are the buckets.

Sets that are equal form one class before banding. Candidates are verified on whole sets:

1. buckets of up to ``SMALL`` classes: all pairs; larger ones: each member with the bucket's two pivots;
2. links give components. A larger bucket whose members lie in several components is not settled yet. Components
   that meet in such buckets form a cloud; in each cloud the members outside its largest component are compared
   with all others, in blocks that give links of components only. So no link that shares a bucket is missed, and no
   pairs within a large group are written out.

A pair at the threshold of 0.8 shares none of the 40 bands of 5 with a probability of 1.3e-7.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer than ``k``
words is one shingle; a null id is linked with nothing and stays; repeated rows of an id share its component, and an
id with several texts has the links of all of them; an empty table gives an empty result; very long texts are taken
whole; further columns are ignored by :func:`near_dedup` and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, cut, discard, side
from .components import components

BANDS, ROWS = 40, 5
SMALL = 8
#: The most classes and elements, on average, on a side of a block of sets that one task compares.
BLOCK, BLOCK_ELEMENTS = 1_024, 500_000
#: Rows of a large bucket in one part of a join.
SPLIT = 1_000
#: Elements that are sketched together.
CHUNK = 400_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles. Only A-Z is folded and only ASCII white space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out * _STEP + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each non-empty set, as one row of ``t`` coordinates."""
    with np.errstate(over="ignore"):
        flat = np.full(len(sets) * t, _EMPTY, np.uint64)
        base = np.repeat(np.arange(len(sets), dtype=np.int64) * t, [len(s) for s in sets])
        elements = np.concatenate(sets)
        for i in range(2 * t):
            h = mix(elements + np.uint64(i + 1) * _STEP)
            value = (np.uint64(i) << np.uint64(54)) | (mix(h + _STEP) >> np.uint64(10))
            place = base + (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else base + (i - t)
            free = flat[place] == _EMPTY
            np.minimum.at(flat, place[free], value[free])
            left = (flat.reshape(-1, t) == _EMPTY).any(axis=1)
            if not left.any():
                break
            if i % 3 == 0 or i >= t:
                stay = left[base // t]
                base, elements = base[stay], elements[stay]
    return flat.reshape(-1, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sketch), bands)).copy()
        cut_up = sketch.reshape(len(sketch), bands, rows)
        for r in range(rows):
            out = mix(out * _STEP + cut_up[:, :, r])
    return out.astype(np.int64)


def _signature(elements: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def _sketch_partition(k: int, bands: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            keys, chunk, size = [], [], 0
            for *key, text in zip(frame["row"], frame["id"], frame["text"]):
                keys.append(key)
                chunk.append(shingle_set(text, k, hashes))
                size += len(chunk[-1])
                if size > CHUNK:
                    yield _rows(keys, chunk, bands, rows)
                    keys, chunk, size = [], [], 0
            if keys:
                yield _rows(keys, chunk, bands, rows)

    return run


def _rows(keys: list, sets: list[np.ndarray], bands: int, rows: int) -> pd.DataFrame:
    full = [i for i, s in enumerate(sets) if len(s)]
    found = np.empty(len(sets), object)
    if full:
        found[full] = list(band_hashes(sketches([sets[i] for i in full], bands * rows), bands, rows))
    of_row, ids = zip(*keys)
    return pd.DataFrame({"row": of_row, "id": pd.array(ids, "Int64"), "n": [len(s) for s in sets], "signature": [_signature(s) for s in sets], "bands": found})


def _set_partition(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            for at in range(0, len(frame), 256):
                sets = [shingle_set(x, k, hashes) for x in frame["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"signature": [_signature(x) for x in sets], "elements": [x.astype(np.int64) for x in sets]})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    with_a = pairs.join(sets.select(F.col("no").alias("a"), F.col("elements").alias("of_a")), "a")
    both = with_a.join(sets.select(F.col("no").alias("b"), F.col("elements").alias("of_b")), "b")
    large, small = F.greatest(F.size("of_a"), F.size("of_b")), F.least(F.size("of_a"), F.size("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    counted = both.where(small * 100 >= large * percent).select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return counted.where(F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).select("a", "b")


def _block_links(percent: int):
    """Compare the classes of one block with those of another; the pairs of components that their links join."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["role"] == 0].reset_index(drop=True), frame[frame["role"] == 1].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        owner = np.repeat(np.arange(len(left)), [len(x) for x in left["elements"]])
        flat = np.concatenate(list(left["elements"]))
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes = np.array([len(x) for x in left["elements"]])
        comps = left["component"].to_numpy()
        seen = set()
        for comp, elements in zip(right["component"], right["elements"]):
            start, stop = np.searchsorted(flat, elements, "left"), np.searchsorted(flat, elements, "right")
            lengths = stop - start
            total = int(lengths.sum())
            if not total:
                continue
            at = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
            shared = np.bincount(owner[at], minlength=len(left))
            hits = (shared * 100 >= (sizes + len(elements) - shared) * percent) & (comps != comp)
            seen.update((c, comp) for c in comps[hits])
        return pd.DataFrame(sorted(seen), columns=["a", "b"]).astype("int64")

    return run


def _classes(sketched: DataFrame) -> DataFrame:
    """One row per distinct set: ``no`` (the least of its rows), least id, the parts of the input it occurs in, bands."""
    usable = sketched.where("n > 0 and id is not null")
    return usable.groupBy("signature").agg(F.min("row").alias("no"), F.min("id").alias("class_id"), F.collect_set("part").alias("parts"), F.first("bands").alias("bands"))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(no, elements) of the classes in ``wanted`` (no, signature, class_id); texts are read again."""
    few = wanted.count() <= FEW_ROWS
    ids = wanted.select(F.col("class_id").alias("id"))
    texts = docs.where("id is not null").join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")
    found = texts.mapInPandas(_set_partition(k), "signature binary, elements array<long>")
    keys = wanted.select("signature", "no")
    return found.dropDuplicates(["signature"]).join(F.broadcast(keys) if few else keys, "signature").select("no", "elements")


def _settled(large: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of components (a, b) that links within the larger buckets join, beyond those with pivots."""
    in_comp = large.join(roots.withColumnRenamed("id", "no"), "no", "left").select("bucket", "no", "c", F.coalesce("component", "no").alias("component"))
    in_comp = cut(in_comp.withColumn("salt", F.pmod(F.xxhash64("no"), F.ceil(F.col("c") / SPLIT))))
    torn = in_comp.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.max(F.ceil(F.col("c") / SPLIT)).alias("salts")).where("first <> last")
    torn = torn.select("bucket", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    members = cut(in_comp.join(torn, ["bucket", "salt"]).select("no", "component", "first").distinct())
    discard(in_comp)
    if members.isEmpty():
        return None
    clouds = components(members.select(F.col("component").alias("a"), F.col("first").alias("b")))
    of_cloud = side(clouds.withColumnRenamed("component", "cloud").withColumnRenamed("id", "component"))
    sized = members.select("no", "component").distinct().join(of_cloud, "component", "left").join(sets, "no")
    placed = cut(sized.select("no", "component", F.coalesce("cloud", "component").alias("cloud"), "elements", F.size("elements").alias("n")))
    sizes = placed.groupBy("cloud", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / BLOCK_ELEMENTS)).cast("int")
    top = F.max(F.struct("m", "component", "n"))
    plan = sizes.groupBy("cloud").agg(top.alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    plan = cut(plan.select("cloud", F.col("top.component").alias("largest"), blocks(F.col("m"), F.col("n")).alias("all"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("outer")))
    rows = placed.join(side(plan), "cloud")
    at = lambda n: F.pmod(F.xxhash64("no"), n).cast("int")
    columns = ["cloud", "component", "elements"]
    left = rows.where("component <> largest").select(*columns, F.lit(0).alias("role"), at(F.col("outer")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("y"))
    right = rows.select(*columns, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"), at(F.col("all")).alias("y"))
    more = cut(left.unionByName(right).groupBy("cloud", "x", "y").applyInPandas(_block_links(percent), "a long, b long"))
    discard(members, placed, plan)
    return more


def _same_ids(sketched: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) of the classes that share an id, which then stands on several texts."""
    usable = sketched.where("n > 0 and id is not null")
    mark = F.xxhash64("signature")
    ids = usable.groupBy("id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("id")
    if ids.isEmpty():
        return None
    met = usable.join(ids, "id").select("id", "signature").distinct().join(classes.select("signature", "no"), "signature").select("id", "no")
    return met.join(met.groupBy("id").agg(F.min("no").alias("a")), "id").select("a", F.col("no").alias("b")).where("a <> b")


def near_components(docs: DataFrame, k: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, n, component`` for each row of ``docs`` (id, text)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    sketched = cut(numbered.mapInPandas(_sketch_partition(k, bands, rows), "row long, id long, n long, signature binary, bands array<long>"))
    sketched = sketched.withColumn("part", F.shiftright("row", 33).cast("int"))
    classes = cut(_classes(sketched))
    members = classes.select("no", F.explode("bands").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("no").alias("low"), F.max("no").alias("high")).where("c > 1"))
    inside = cut(members.join(buckets, "bucket"))
    discard(buckets)

    small, large = inside.where(f"c > 2 and c <= {SMALL}").select("bucket", "no"), inside.where(f"c > {SMALL}")
    pairs = small.select("bucket", F.col("no").alias("a")).join(small.select("bucket", F.col("no").alias("b")), "bucket").select("a", "b")
    couples = inside.where("c = 2 and no = low").select(F.col("low").alias("a"), F.col("high").alias("b"))
    ends = F.array(F.struct(F.col("low").alias("a"), F.col("no").alias("b")), F.struct(F.col("no").alias("a"), F.col("high").alias("b")))
    pairs = cut(pairs.unionByName(couples).unionByName(large.select(F.inline(ends))).where("a < b").distinct())
    wanted = cut(classes.select("no", "signature", "class_id").join(inside.select("no").distinct(), "no", "left_semi"))
    sets = cut(_sets(docs, wanted, k))
    links = _verified(pairs, sets, percent)
    if (same := _same_ids(sketched, classes)) is not None:
        links = links.unionByName(same)
    roots = components(links)
    if (more := _settled(large, roots, sets, percent)) is not None:
        further = side(cut(components(more)).select(F.col("id").alias("component"), F.col("component").alias("to")))
        joined = roots.join(further, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        roots = cut(joined.unionByName(further.join(roots.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("to").alias("component"))))
    discard(inside, pairs, wanted, sets)

    linked = roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
    of_class = classes.select("no", "class_id").join(linked.withColumnRenamed("id", "no"), "no")
    least = side(cut(of_class.groupBy("component").agg(F.min("class_id").alias("least"))))
    named = linked.withColumnRenamed("id", "no").join(least, "component").select("no", "least")
    named = classes.select("signature", "no", "class_id", F.explode("parts").alias("part")).join(named, "no", "left").select("signature", "part", F.coalesce("least", "class_id").alias("component"))
    full = sketched.select("id", "n", "signature", "part").join(named, ["signature", "part"], "left")
    return full.select("id", "n", F.expr("case when n > 0 and id is not null then component else id end").alias("component"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    found = near_components(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")), k, percent)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group, all columns kept."""
    gone = near_dedup(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.select(F.struct("*").alias("doc")).join(gone, F.col("doc.doc_id") == F.col("gone_id"), "left_anti").select("doc.*")


def brute_force(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> list[tuple]:
    """The result of :func:`near_dedup` for a small fixture with distinct ids, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        n = min(k, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sets]
