"""Spelling variants: words one letter apart, by PartEnum signatures of their letter multisets.

A word's letters, each with the number of the same letters before it, are a set: a binary vector. One letter put in, out
or in place of another moves that vector by at most two. The positions of the vector are dealt into ``PARTS`` parts, and a
signature is the word's projection on a choice of parts: of two words of one length, which differ in at most two
positions, all but two parts agree somewhere; of words whose lengths differ by one, which then differ in one position,
all but one. Every choice is enumerated, so words that are near share a signature for sure. As one edit leaves either the
first or the last half of the shorter word in place, a signature is taken once with each half; that is exact, too, and
keeps words of the same letters in another order apart. Signatures are joined by their hashes, and each pair is verified
by its edit distance. Nothing is capped: a signature that very many words share is a skewed join key, which Spark splits.

A word's form is its most frequent near word, if that is at least ``RATIO`` times as frequent; following forms leads to
ever more frequent words, so it ends. The last form is found by doubling: each round doubles the steps that are known.

Edge cases: null and empty texts have no words; a null id counts as the empty text in a document's mark; repeated rows
count as often as they occur; an empty table, or one without frequent words, gives an empty result; further columns are
ignored; long texts are read whole; of near words of equal frequency the first in code-point order is the form.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, side, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
SHORTEST, LEAST, RATIO = 5, 3, 2
PARTS = 5
#: Rounds of doubling; a chain of forms has at most 63 steps, as frequencies double.
MAX_ROUNDS = 8


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: each maximal run of letters of each text, A-Z in lower case."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(RUN), 0)).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, without one letter where ``every`` divides the mark of document and run: typos that follow from the data."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(mark, F.char_length(run)).cast("int")
    return F.when(mark % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def frequent(words: DataFrame) -> DataFrame:
    """``word, n`` of the words of at least ``SHORTEST`` letters that occur ``LEAST`` times or more; ``words`` has one column."""
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


class Signatures:
    """The signatures of words; ``part`` remembers in which part a letter with its number lies."""

    def __init__(self, parts: int = PARTS):
        self.parts, self.known = parts, {}
        self.alike, self.longer = list(combinations(range(parts), parts - 2)), list(combinations(range(parts), parts - 1))

    def part(self, letter: str, number: int) -> int:
        at = self.known.get((letter, number))
        if at is None:
            at = self.known[letter, number] = xxhash.xxh32_intdigest(f"{letter}{number}") % self.parts
        return at

    def of(self, word: str) -> Iterator[tuple[int, int]]:
        """(role, signature): role 0 for words of one length; 1 and 2 for the shorter and the longer of two."""
        seen, parts = defaultdict(int), [[] for _ in range(self.parts)]
        for letter in sorted(word):
            parts[self.part(letter, seen[letter])].append(letter)
            seen[letter] += 1
        projected = ["".join(p) for p in parts]
        length = len(word)
        for role, short, choices in ((0, length, self.alike), (1, length, self.longer), (2, length - 1, self.longer)):
            half = short // 2
            ends = (f"<{word[:half]}", f">{word[length - (short - half) :]}")
            for choice in choices:
                base = f"{role > 0}|{short}|{choice}|{'|'.join([projected[i] for i in choice])}|"
                for end in ends:
                    yield role, xxhash.xxh3_64_intdigest(base + end)


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    signatures = Signatures()
    for frame in frames:
        for at in range(0, len(frame), 5_000):
            out = [(role, sig - (1 << 63), word, n) for word, n in zip(frame["word"].iloc[at : at + 5_000], frame["n"].iloc[at : at + 5_000]) for role, sig in signatures.of(word)]
            yield pd.DataFrame(out, columns=["role", "signature", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one edit apart, once. ``words`` (word, n) is read twice."""
    signed = cut(words.mapInPandas(_signed, "role int, signature long, word string, n long"))
    left = signed.where("role < 2").select("signature", "role", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.where("role <> 1").select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "signature").where((F.col("role") == 1) | (F.col("a") < F.col("b")))
    pairs = cut(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct())
    discard(signed)
    return pairs


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: near words of each of ``words`` (word, n), and the form it varies."""
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    per = pairs.select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    met = words.join(per, "word", "left").withColumn("known", -F.col("best.n") >= RATIO * F.col("n"))
    return met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("known"), F.col("best.word")).alias("form"), F.when(F.col("known"), -F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``forms`` (word, form), without nulls, ends."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        further = side(at.select(F.col("word").alias("root"), F.col("root").alias("next")))
        after = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        at = after
        if at.where("moved").isEmpty():
            return at.select("word", "root")
    raise RuntimeError("forms run in circles")


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` of each of ``words`` (word, n)."""
    found = cut(variants(words))
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    """:func:`spelling_groups` of the frequent words of all documents, with typos that follow from the data."""
    return spelling_groups(cut(frequent(runs(docs).select(misspelt(F.col("run"), F.col("doc_id")).alias("word")))))


def near(a: str, b: str) -> bool:
    """Whether one letter put in, out or in place of another makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_force(counts: dict[str, int]) -> list[tuple]:
    """The result of :func:`spelling_groups` for a few words, by comparing all of them."""
    out, form = {}, {}
    for w, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if near(w, o))
        if others and -others[0][0] >= RATIO * n:
            form[w] = others[0][1]
        out[w] = (n, form.get(w), counts[form[w]] if w in form else None, len(others))
    end = lambda w: end(form[w]) if w in form else w
    return [(w, *x, end(w)) for w, x in out.items()]


_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))"


def crc32_sql(s: str) -> str:
    """SQL of the CRC-32 of a text ``s`` without characters above U+07FF, bit by bit."""
    bits = f"flatten(list_transform({_BYTES.replace('string_split(s,', f'string_split({s},')}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(x, b) >> 1, CASE WHEN xor(x, b) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda x, b: {step}), 4294967295)"


ORACLE_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents) GROUP BY ALL
), marked AS (
  SELECT run, c, {crc32_sql("doc_id || ':' || run")} AS h FROM runs
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM marked) WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {LEAST}
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM pairs GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * n THEN other END AS form, CASE WHEN most >= {RATIO} * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), ends AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, e.root FROM forms f JOIN ends e ON f.form = e.word
)
SELECT word, n, form, form_n, n_near, root FROM forms JOIN ends USING (word)
"""
