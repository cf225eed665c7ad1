"""Line deduplication by distinct-site spread.

A line is boilerplate if it occurs on ``min_sites`` sites or more. Lines that occur too rarely for that are ruled out
by a count; for the rest HyperLogLog sketches of their sites merge by aggregation. An estimate far from the threshold
decides; a line near it gets an exact distinct count. Boilerplate lines go from every document.

A line is compared without the white space around it; blank lines are no boilerplate and stay. A null source is no
site. Candidates and boilerplate are joined by broadcast up to ``FEW`` lines, by shuffle beyond.

Edge cases: a null text is passed on as the empty text; an empty table gives an empty result; repeated rows are
cleaned alike; further columns, with whatever names, are kept by :func:`drop_boilerplate`; long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; the sketch's standard error is under 2 %.
NEAR = 0.25
FEW = 200_000
_AROUND = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_AROUND))


def _key(line: Column) -> Column:
    return F.xxhash64(trimmed(line), F.hash(trimmed(line)))


def _near_side(df: DataFrame) -> DataFrame:
    """``df``, which is written already, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key) of the lines that occur on ``min_sites`` sites or more; ``docs`` has text and source."""
    each = docs.select(F.col("source").cast("string").alias("site"), F.explode(lines_of(text_of())).alias("line")).where((trimmed(F.col("line")) != "") & F.col("site").isNotNull())
    each = each.select("site", _key(F.col("line")).alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b")).where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites < 2)))
    some = each.join(_near_side(cut(often.select("key"))), "key")
    spread = cut(some.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")))
    far = spread.where(F.col("sites") >= min_sites * (1 + NEAR)).select("key")
    close = cut(spread.where((F.col("sites") >= min_sites * (1 - NEAR)) & (F.col("sites") < min_sites * (1 + NEAR))).select("key"))
    exact = each.join(_near_side(close), "key").groupBy("key").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return far.unionByName(exact.select("key"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, as (doc, n_lines, n_removed), doc a struct."""
    found = cut(boilerplate(docs.select("text", "source"), min_sites))
    whole = docs.select(F.struct("*").alias("doc"), text_of().alias("body"))
    held = whole.select(F.col("doc.doc_id").alias("id"), F.xxhash64("body").alias("body_hash"), F.explode(F.array_distinct(F.transform(lines_of(F.col("body")), _key))).alias("key"))
    per_doc = held.join(_near_side(found), "key").groupBy("id", "body_hash").agg(F.collect_set("key").alias("gone"))
    told = whole.withColumn("hash", F.xxhash64("body")).join(per_doc, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("body_hash")), "left")
    lines = lines_of(F.col("body"))
    kept = F.filter(lines, lambda x: ~F.array_contains("gone", _key(x)))
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return told.select(F.col("doc").withField("text", text).alias("doc"), F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"))


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    cleaned = drop_boilerplate(docs, min_sites)
    return cleaned.select("doc.doc_id", "n_lines", "n_removed", F.length("doc.text").cast("long").alias("n_chars"), F.sha2("doc.text", 256).alias("text_sha256"))


def oracle(min_sites: int = MIN_SITES) -> str:
    around = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT source, trim(l, {around}) AS l FROM (SELECT source, unnest(ls) AS l FROM d)),
bad AS (SELECT l FROM each WHERE l <> '' GROUP BY l HAVING count(DISTINCT source) >= {min_sites}),
pos AS (SELECT doc_id, ls, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
kept AS (
  SELECT doc_id, len(any_value(ls)) AS n_lines, count(bad.l) AS n_removed, coalesce(string_agg(pos.l, chr(10) ORDER BY i) FILTER (bad.l IS NULL), '') AS t
  FROM pos LEFT JOIN bad ON trim(pos.l, {around}) = bad.l GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(t) AS n_chars, sha256(t) AS text_sha256 FROM kept
"""
