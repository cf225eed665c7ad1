"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, pii, prefix_trie, spelling, substring_dedup, token_counts
from .chat import format_chats
from .common import WORD, shared_dir, table, text_of
from .decontaminate import contaminated
from .exact_dedup import dedup
from .html_extract import extract
from .mixing import mix
from .near_dedup import near_dedup
from .quality import classify


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents that hold words, kept up through four batches.

    An earlier state of the corpus, all in lower case, is loaded; every document is then revised to its present text; those
    without words are deleted; and the revision is sent once more, as after a lost answer.
    """
    ledger, docs = f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}", table(spark, sf_dir, "documents").select("source", "lang", "text")
    old = F.lower("text")
    revision = token_counts.changes(revised=docs.withColumn("old_text", old))
    token_counts.commit(token_counts.changes(inserted=docs.withColumn("text", old)), ledger, "load")
    token_counts.commit(revision, ledger, "revision")
    token_counts.commit(token_counts.changes(deleted=docs.where(~text_of().rlike(WORD))), ledger, "deletion")
    token_counts.commit(revision, ledger, "revision")
    return token_counts.totals(spark, ledger)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=2)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op7_minhash": op7_minhash,
    "op8_chat": op8_chat,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pii": pii.oracle(),
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
    "op13_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_line_dedup": line_dedup.oracle(),
    "op6_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
}
