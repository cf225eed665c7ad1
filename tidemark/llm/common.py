"""What the operators of this subpackage share: table access and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a Java character class and as the characters themselves.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to this many rows of a few numbers each, by count.
FEW_ROWS = 200_000

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset in local mode, as in tests, a temporary
    folder of this machine is taken. On a cluster it has to be set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that lost executors cost no recomputation."""
    folder = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _written[out] = folder
    if (scope := _scope.get()) is not None:
        scope.append(folder)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all that :func:`cut` wrote inside, also after an error; results have to be written by then."""
    folders: list[str] = []
    token = _scope.set(folders)
    try:
        yield
    finally:
        _scope.reset(token)
        for folder in folders:
            remove(spark, folder)


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`cut` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, _written.pop(df))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def side(df: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if it is small by count; beyond, the join is shuffled."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """A text column, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shards_for(rows: int, per_shard: int, spark: SparkSession) -> int:
    """How many shards of about ``per_shard`` rows; at least as many as the shuffle has partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_shard))
