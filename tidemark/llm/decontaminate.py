"""Benchmark decontamination by template canonicalisation.

Texts become tokens: runs of letters and digits. Numbers become ``<num>``, units ``<unit>``, capitalised words within a
sentence ``<name>``, all other words themselves in lower case. Windows of ``WINDOW`` such tokens of the benchmark are
hash-joined with those of the documents, so a question with other numbers or names still matches. The slots then
decide: one value in the item has to stand for one value in the document; an item counts if ``COVER`` of its windows
are matched and ``CONSISTENT`` of its slots agree with such a mapping. That is asked of all matched windows of the
document together and of each occurrence by itself, as a document may hold a question twice with different values. An
occurrence is a run of matches, in document order, along which the place in the item grows.

Beside the templates stands an exact path for every item: runs of ``RUN`` raw tokens (the words as they are, in lower
case; single characters in scripts without spaces), the whole item if it is shorter. One run that a document holds
is enough, whatever its cover and however few ordinary words it has.

The benchmark's windows are sent to the tasks, as a filter and for the join, only up to ``FEW_BYTES`` of them; beyond,
all windows of the documents are shuffled and joined, those that very many places hold in parts.

Tasks read the texts of a batch as one array of code points. Token borders, the codes of tokens and the hashes of
windows all come from running sums over it, so no Python code runs per word. Case is folded by code point.

Edge cases: null, empty or blank texts match nothing; items shorter than a window are one window of their own
length, from ``SHORTEST`` tokens on (shorter ones match verbatim only, so an item of one word matches every text with that word);
a window with fewer than ``WORDS`` words between its slots is no evidence by itself; repeated benchmark items and repeated rows give the same answer once
per row's id; a null ``doc_id`` is never reported, an item without an ``item_id`` counts like any other but adds nothing to
``item_ids``; several texts of one ``doc_id`` are judged each by itself, and one that leaks speaks for the id; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .near_dedup import mix

WINDOW = 8
SHORTEST = 5
WORDS = 4
#: Raw tokens in a row that are a leak by themselves.
RUN = 13
COVER = 0.5
CONSISTENT = 0.8
#: The benchmark's windows with their slots, in bytes, up to which they are sent to every task.
FEW_BYTES = 32_000_000
#: Code points that a task reads together; a longer text is read alone.
BATCH = 400_000
#: Places of the documents with one window of the benchmark in one part of a join.
HOT = 100_000

#: Units that are replaced.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years dollar dollars euro euros pound pounds cent cents usd eur gbp meter meters metre metres kilometer kilometers mile miles inch "
    "inches foot feet yard yards gram grams kilogram kilograms liter liters litre litres percent degree degrees celsius fahrenheit watt watts volt volts".split()
)
NUM, UNIT, NAME = (np.uint64(x) for x in (1, 2, 3))
#: Code points of scripts that are written without spaces (Thai to Lao, Burmese, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
ENDS = '.!?:;\n"|'
SUFFIXES = ("st", "nd", "rd", "th")
#: Bits of a code point's kind. Letters and digits beyond ``LAST`` do not exist.
INSIDE, END, UPPER, LOWER, DIGIT, ALONE = (np.uint8(1 << i) for i in range(6))
LAST = 0x3FFFF

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind, its lower case, and a random number for that."""
    chars = [chr(i) for i in range(LAST + 1)]
    kind = np.zeros(LAST + 1, np.uint8)
    for bit, test in ((INSIDE, str.isalnum), (UPPER, lambda c: c.isupper() or c.istitle()), (LOWER, str.islower), (DIGIT, str.isdecimal)):
        kind[[test(c) for c in chars]] |= bit
    kind[[ord(c) for c in ENDS]] |= END
    for low, high in UNSPACED:
        kind[low : high + 1] |= ALONE & -(kind[low : high + 1] & INSIDE)
    low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    with np.errstate(over="ignore"):
        return kind, low, mix(low.astype(np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts: the text of each, where it lies in the whole, and its code."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray


class Texts:
    """Texts read as one array of code points, each ended by a line feed."""

    def __init__(self, texts: list[str]):
        self.whole = "\n".join(texts)
        kinds, self.lows, values = _tables()
        self.points = np.minimum(np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(LAST))
        self.kind = kinds[self.points]
        self.first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        with np.errstate(over="ignore"):
            base, self.back = powers(len(self.points))
            self.sums = np.zeros(len(self.points) + 1, np.uint64)
            np.cumsum(values[self.points] * base, out=self.sums[1:])

    def _tokens(self, apart: np.ndarray | None) -> Tokens:
        """Runs of letters and digits; those of ``apart`` are tokens by themselves."""
        inside = np.zeros(len(self.kind) + 2, bool)
        inside[1:-1] = self.kind & INSIDE
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        if apart is not None:
            alone = np.zeros(len(self.kind) + 2, bool)
            alone[1:-1] = apart
            border = inside[1:] & inside[:-1] & (alone[1:] | alone[:-1])
            starts, ends = starts | border, ends | border
        start, end = np.nonzero(starts)[0], np.nonzero(ends)[0]
        with np.errstate(over="ignore"):
            code = mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)) | np.uint64(8)
        return Tokens(np.searchsorted(self.first, start, "right") - 1, start, end, code)

    def plain(self) -> Tokens:
        """The tokens with the codes of their lower case."""
        return self._tokens(None)

    def raw(self, plain: Tokens) -> Tokens:
        """The plain tokens, but for scripts without spaces, where each character is a token."""
        apart = (self.kind & ALONE) > 0
        return self._tokens(apart) if apart.any() else plain

    def canonical(self, plain: Tokens) -> Tokens:
        """The tokens with placeholders for numbers, units and capitalised words that open no sentence."""
        code = plain.code.copy()
        opening = self.kind[plain.start]
        names = np.nonzero(opening & UPPER)[0]
        if names.size:
            start, end = plain.start[names], plain.end[names]
            uppers, lowers = (np.concatenate(([0], np.cumsum((self.kind & bit) > 0))) for bit in (UPPER, LOWER))
            ends = np.nonzero(self.kind & END)[0]
            before = np.where(names > 0, plain.end[names - 1], 0)
            inner = np.searchsorted(ends, start) == np.searchsorted(ends, before)
            code[names[(uppers[end] - uppers[start] == 1) & (lowers[end] - lowers[start] > 0) & inner & (names > 0)]] = NAME
        code[_units().known(plain.code)] = UNIT
        numbers = np.nonzero(opening & DIGIT)[0]
        if numbers.size:
            start, end = plain.start[numbers], plain.end[numbers]
            digits = np.concatenate(([0], np.cumsum((self.kind & DIGIT) > 0)))
            digits = digits[end] - digits[start]
            last = np.stack([self.lows[self.points[np.maximum(end - k, 0)]] for k in (2, 1)])
            ordinal = np.any([(last[0] == ord(a)) & (last[1] == ord(b)) for a, b in SUFFIXES], axis=0)
            code[numbers[(digits == end - start) | ((digits == end - start - 2) & ordinal)]] = NUM
        return Tokens(plain.doc, plain.start, plain.end, code)


@cache
def _units() -> Wanted:
    return Wanted(Texts(sorted(UNITS)).plain().code.view(np.int64))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, from the first one on."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.full(max(n, 2 * len(_powers[k])), base, np.uint64), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Hashes of the runs of any length of one text, from sums of powers."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            base, self.back = powers(len(codes))
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mix(codes) * base, out=self.sums[1:])

    def hashes(self, n: int) -> np.ndarray:
        if len(self.back) < n:
            return np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.back) - n + 1] + np.uint64(n)).astype(np.int64)


class Wanted:
    """A set of hashes: a table by their first bits, and the sorted hashes for what it lets pass."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._first(self.sorted)] = True

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The places of those that are in the set."""
        hashes = hashes.view(np.int64)
        near = np.nonzero(self.table[self._first(hashes)])[0]
        at = np.searchsorted(self.sorted, hashes[near])
        at[at == len(self.sorted)] = 0
        return near[self.sorted[at] == hashes[near]] if len(self.sorted) else near[:0]


def telling(tokens: Tokens, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the windows of ``n`` tokens from ``at`` on that hold enough ordinary words."""
    words = np.concatenate(([0], np.cumsum(tokens.code > NAME)))
    return at[words[at + n] - words[at] >= min(WORDS, n)]


def _found(texts: Texts, lengths: list[int], wanted: dict[int, Wanted] | None) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(text, hash, place, length, slots) of the windows and, with their length below 0, runs of raw tokens that are wanted."""
    plain = texts.plain()
    if not len(plain.code):
        return
    for tokens, own in ((texts.canonical(plain), [n for n in lengths if n > 0]), (texts.raw(plain), [n for n in lengths if n < 0])):
        runs, first = Runs(tokens.code), np.searchsorted(tokens.doc, np.arange(len(texts.first)))
        for n in own:
            hashes, size = runs.hashes(abs(n)), abs(n)
            at = np.arange(len(hashes)) if wanted is None else wanted[n].known(hashes)
            at = at[tokens.doc[at] == tokens.doc[at + size - 1]]
            if n > 0:
                at = telling(tokens, at, n)
            for i in at:
                slots = [texts.whole[tokens.start[j] : tokens.end[j]].lower() for j in range(i, i + n) if tokens.code[j] <= NAME]
                yield tokens.doc[i], hashes[i], i - first[tokens.doc[i]], n, slots


def _item_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows and runs of each item; of one shorter than them the whole."""
    for frame in frames:
        out = []
        for *key, text in zip(frame["id"], frame["mark"], frame["text"]):
            texts = Texts([text or ""])
            plain = texts.plain()
            size, raw = min(WINDOW, len(plain.code)), min(RUN, len(texts.raw(plain).code))
            found = list(_found(texts, ([size] if size >= SHORTEST else []) + ([-raw] if raw else []), None))
            telling_windows = sum(n > 0 for _, _, _, n, _ in found)
            out += [(*key, h, at, n, telling_windows if n > 0 else len(found) - telling_windows, slots) for _, h, at, n, slots in found]
        yield pd.DataFrame(out, columns=_COLUMNS)


def _document_rows(lengths: list[int], hashes_of: dict[int, np.ndarray] | None):
    """The windows and runs of each document, only those in ``hashes_of`` if it is given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = None if hashes_of is None else {n: Wanted(h) for n, h in hashes_of.items()}
        for frame in frames:
            keys, texts, size = [], [], 0
            for *key, text in zip(frame["id"], frame["mark"], frame["text"]):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1])
                if size > BATCH:
                    yield rows(keys, texts, wanted)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts, wanted)

    def rows(keys: list[list[int]], texts: list[str], wanted: dict[int, Wanted] | None) -> pd.DataFrame:
        return pd.DataFrame([(*keys[d], h, at, n, 0, slots) for d, h, at, n, slots in _found(Texts(texts), lengths, wanted)], columns=_COLUMNS)

    return run


_COLUMNS = ["id", "mark", "hash", "at", "length", "windows", "slots"]
_ROW = "id long, mark long, hash long, at int, length int, windows int, slots array<string>"


def _salted(found: DataFrame, items: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by window, with those windows that more than ``hot`` places of the documents hold in parts."""
    by = ["hash", "length"]
    counts = found.groupBy(*by).agg(F.count("*").alias("c")).where(F.col("c") > hot)
    salts = cut(items.select(*by).distinct().join(counts, by).select(*by, F.ceil(F.col("c") / hot).alias("salts")))  # of the benchmark's windows alone
    one = F.lit(1).cast("long")
    left = found.join(salts, by, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "doc_at"), F.coalesce("salts", one))).drop("salts")
    right = items.join(salts, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", one) - 1))).drop("salts")
    return left, right


def leaks(docs: DataFrame, benchmark: DataFrame, few: int = FEW_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, item_id, matched, windows, cover, consistent) for each document and benchmark item that it holds.

    Items are known by their id, those without one by their text. The texts of one ``doc_id`` are judged one by one.
    """
    key = F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text"))
    named = benchmark.select(key.alias("id"), F.col("item_id").isNull().cast("long").alias("mark"), "text").where("text is not null")
    items = cut(named.mapInPandas(_item_rows, _ROW))
    lengths = [r[0] for r in items.select("length").distinct().collect()]  # at most WINDOW - SHORTEST + 1 + RUN values
    wanted = None
    if (items.agg(F.sum(64 + F.length(F.array_join("slots", "        ")))).first()[0] or 0) <= few:
        each = items.select("length", "hash").distinct().toPandas()  # few / 64 rows of two numbers at the most
        wanted = {n: each.loc[each["length"] == n, "hash"].to_numpy(np.int64) for n in lengths}
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), "text").where("id is not null and text is not null")
    if not lengths:
        texts = texts.limit(0)
    found = texts.mapInPandas(_document_rows(lengths, wanted), _ROW).select(F.col("id").alias("doc_id"), "mark", "hash", "length", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    of_items = items.select(F.col("id").alias("item"), F.col("mark").alias("unnamed"), "hash", "length", F.col("at").alias("item_at"), "windows", F.col("slots").alias("item_slots"))
    if wanted is not None:
        met = found.join(F.broadcast(of_items), ["hash", "length"])
    else:
        left, right = _salted(cut(found), of_items, hot)
        met = left.join(right, ["hash", "length", "salt"]).drop("salt")
    met = met.withColumn("raw", F.col("length") < 0)
    both = ["doc_id", "mark", "item", "unnamed"]
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("doc_slots").alias("b"))
    run = Window.partitionBy(*both, "raw").orderBy("doc_at", "item_at")
    before = F.lag("item_at").over(run)
    again = (F.col("item_at") == before) & (F.col("doc_at") > F.lag("doc_at").over(run))
    restart = F.when((F.col("item_at") < before) | again, 1).otherwise(0)
    runs = met.withColumn("restart", restart).withColumn("occurrence", F.sum("restart").over(run))
    each = runs.groupBy(*both, "raw", "occurrence").agg(
        F.collect_set("item_at").alias("places"), F.max("windows").alias("windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    each = each.withColumn("told", F.when(F.col("raw"), _exact(F.col("places"), F.col("windows"))).otherwise(_told(F.col("places"), F.col("windows"), F.col("pairs"))))
    together = _told(F.array_distinct(F.flatten("all_places")), F.coalesce("windows", F.lit(1)), F.array_distinct(F.flatten("all_pairs")))
    per = each.groupBy(*both).agg(
        F.collect_list(F.when(~F.col("raw"), F.col("places"))).alias("all_places"),
        F.max(F.when(~F.col("raw"), F.col("windows"))).alias("windows"),
        F.collect_list(F.when(~F.col("raw"), F.col("pairs"))).alias("all_pairs"),
        F.max("told").alias("best"),
    )
    told = per.select("doc_id", "item", "unnamed", F.greatest(together, "best").alias("told")).where("told.leaks")
    best = told.groupBy("doc_id", "item", "unnamed").agg(F.max("told").alias("told"))
    return best.select("doc_id", F.when(F.col("unnamed") == 0, F.col("item")).alias("item_id"), "told.matched", "told.windows", "told.cover", "told.consistent")


def _exact(places: Column, windows: Column) -> Column:
    """As :func:`_told`, for runs of raw tokens: one is enough."""
    return F.struct(F.lit(True).alias("leaks"), (F.size(places) / windows).alias("cover"), F.lit(1.0).alias("consistent"), F.size(places).alias("matched"), windows.alias("windows"))


def _told(places: Column, windows: Column, pairs: Column) -> Column:
    """(leaks, cover, consistent, matched, windows) of a set of matched windows and their pairs of slot values."""
    agreeing = F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))), F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"])))
    share = F.when(F.size(pairs) == 0, 1.0).otherwise(F.least(*agreeing) / F.greatest(F.size(pairs), F.lit(1)))
    cover = F.size(places) / windows
    leak = (cover >= COVER) & (share >= CONSISTENT)
    return F.struct(leak.alias("leaks"), cover.alias("cover"), share.alias("consistent"), F.size(places).alias("matched"), windows.alias("windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: ``doc_id, item_ids, n_items, best_cover``."""
    return (
        leaks(docs, benchmark)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"), F.round(F.max("cover"), 6).alias("best_cover"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("gone_id"))
    return docs.select(F.struct("*").alias("doc")).join(gone, F.col("doc.doc_id") == F.col("gone_id"), "left_anti").select("doc.*")
