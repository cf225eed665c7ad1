"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and its result is written and read again.

For every stage: a null text counts as the empty text; a null id is never a reason to drop a row, but for copies of
other rows; further columns are kept by all stages but the last, whatever their names; an empty table gives an empty
table; long texts are read whole. What each stage does with repeated rows and ties is said below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from tidemark.llm.common import remove, scratch, shared_dir, table

#: The setting that names a new folder for the mix's blocks; unset, the last stage gives their totals only.
MIX_DIR = "spark.tidemark.mix.dir"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts are scored, too; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: the longest, then that of the smallest id. Empty texts are copies; of repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that of the smallest id.

    Texts without words, and rows without an id, stay; so do repeated rows of the id that stays.
    """
    return near_dedup.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; rows without a text or an id stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each remaining document the mix takes: ``doc_id, size, source_size, target, taken, pieces, first_shard``.

    One row per row of ``docs``; texts without words have size 0 and are not taken; a null source is one of its own. Where
    ``MIX_DIR`` names a folder, the mix itself, (shard, place, source, block, words, text), is written there.
    """
    folder = spark.conf.get(MIX_DIR, None)
    return mixing.written_mix(docs, folder) if folder else mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mixed),
]

#: Classifying and near-duplicate search cannot be said in SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage has written on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
