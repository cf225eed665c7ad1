"""Session settings in one place."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of so many files or more are read as they are.
FEW_FILES = 16


def spread(df: DataFrame) -> DataFrame:
    """``df``, which reads files, dealt to all cores if it is one of a few files.

    A small file is one row group, so one task would do all that follows up to the first exchange. Large tables have
    many files; they are not shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, FEW_FILES) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a path of the shared store is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a file or folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of the shared store; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []


def read_file(spark: SparkSession, name: str) -> str:
    """The content of a small file of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_file(spark: SparkSession, name: str, content: str) -> bool:
    """Writes a small file of the shared store, whole or not at all; False if there is one of that name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(name)
    part, store = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}"), path.getFileSystem(conf)
    stream = store.create(part, True)
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(part, path, never)
        return True
    except Py4JJavaError as problem:
        store.delete(part, False)
        if "FileAlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise


def materialised(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; for small tables that a plan reads several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
