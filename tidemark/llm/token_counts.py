"""Token counts as delta-maintained rollups.

A ledger in the shared store holds one folder per batch. A batch is a set of signed changes: inserts add a document's
counts, deletes take them away, a revision is a delete of the old counts and an insert of the new ones. Each batch is
summed by source, language and tokenizer version before it is written, so a ledger grows with batches and not with
documents, and totals are the sum over batches. A batch is committed once by its id: committing it again changes nothing.

Edge cases: a null text has no tokens, no bytes and no words but is a document; null source or language is a key of
its own; a key whose documents are all gone is left out; an empty table gives no rows; long texts are tokenised
whole; further columns are ignored; repeated rows count as often as they occur.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' files are; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"
VERSION = "byte_bpe_50k"
KEYS = ("source", "lang", "tokenizer")
COUNTS = ("docs", "tokens", "bytes", "words")
LEDGER = "source string, lang string, tokenizer string, docs long, tokens long, bytes long, words long"

#: Fixed value: the splitting pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def encoder(folder: str, version: str):
    """A tokenizer from its file of ranks, read once per Python worker."""
    if (folder, version) not in _encoders:
        import tiktoken

        with open(f"{folder}/{version}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[folder, version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[folder, version]


def count_tokens(text: str | None, enc) -> int:
    return len(enc.encode_ordinary(text)) if text else 0


def counted(docs: DataFrame, sign: Column, folder: str = TOKENIZERS, version: str = VERSION) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens, bytes, words): one row per group of a batch of rows, times ``sign``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, version)
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            out = pd.DataFrame({
                "source": frame["source"], "lang": frame["lang"], "tokenizer": version, "docs": frame["sign"], "tokens": [count_tokens(t, enc) for t in texts],
                "bytes": [len(r) for r in raw], "words": [len(r.split()) for r in raw],
            })
            for c in COUNTS[1:]:
                out[c] *= out["docs"]
            yield out.groupby(list(KEYS), dropna=False, as_index=False)[list(COUNTS)].sum().astype(object).where(lambda x: x.notna(), None)

    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text", sign.cast("long").alias("sign")).mapInPandas(run, LEDGER)


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None, folder: str = TOKENIZERS, version: str = VERSION) -> DataFrame:
    """The signed counts of one batch. ``revised`` has ``old_text`` beside the columns of a document."""
    parts = []
    if inserted is not None:
        parts.append(counted(inserted, F.lit(1), folder, version))
    if deleted is not None:
        parts.append(counted(deleted, F.lit(-1), folder, version))
    if revised is not None:
        old = revised.select("source", "lang", F.col("old_text").alias("text"))
        parts += [counted(revised, F.lit(1), folder, version), counted(old, F.lit(-1), folder, version)]
    return summed(reduce(DataFrame.unionByName, parts))


def commit(delta: DataFrame, ledger: str, batch: str) -> bool:
    """Write a batch; False if its id is committed already, which then changes nothing.

    The rows are written under a name of this attempt and get that of the batch by one rename, so readers see a batch
    as a whole or not at all, and what a crashed attempt left counts for nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    spark, attempt = delta.sparkSession, f"{ledger}/attempts/{batch}-{uuid.uuid4().hex}"
    of, to = spark._jvm.org.apache.hadoop.fs.Path(attempt), spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batches/{batch}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to):
        return False
    delta.write.parquet(attempt)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(of, to):
        fs.delete(of, True)
        return False
    return True


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """The additive totals over all batches, of the keys that still have documents."""
    return summed(spark.read.schema(LEDGER).parquet(f"{ledger}/batches/*")).where("docs <> 0")


def compact(spark: SparkSession, ledger: str, into: str) -> None:
    """A new ledger with one batch that holds the totals."""
    commit(totals(spark, ledger), into, "base")
