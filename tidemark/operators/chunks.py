"""Series of any length in chunks: numbering, windows with a halo, running sums. No task holds a whole series.

Rows are numbered within their key over range partitions with offsets. ``size`` rows in order make a chunk. A window that
reaches back ``reach`` rows is computed per chunk, after each chunk got copies of the last rows before it; a running sum
is the chunk's own plus what the chunks before add up to, which is one row per chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

ROW, CHUNK, OWN = "row_no", "chunk_no", "in_chunk"


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their number in the order within their key, from 1 on. The order has to be total within a key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = materialised(ranged.withColumns({"row_part": F.spark_partition_id(), "row_at": F.monotonically_increasing_id()}))
    per = placed.groupBy(*keys, "row_part").agg(F.count("*").alias("rows_in"), F.min("row_at").alias("first_at"))
    before = F.sum("rows_in").over(Window.partitionBy(*keys).orderBy("row_part")) - F.col("rows_in")  # a row per key and partition
    offsets = per.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("row_part").alias("of_part"), (before - F.col("first_at") + 1).alias("row_offset"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    met = placed.join(offsets, (F.col("row_part") == F.col("of_part")) & same)
    return met.select(*rows.columns, (F.col("row_at") + F.col("row_offset")).alias(ROW))


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """:func:`numbered` rows, with the number of their chunk, from 0 on."""
    return numbered(rows, keys, order).withColumn(CHUNK, F.floor((F.col(ROW) - 1) / size).cast("long"))


def with_halo(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """Chunked rows, and before each chunk copies of the ``reach`` rows that come before it; ``in_chunk`` tells them apart."""
    far = -(-reach // size)
    copies = F.transform(F.sequence(F.lit(0), F.lit(far)), lambda k: F.col(CHUNK) + k)
    each = rows.withColumn("of_chunk", F.explode(copies)).where((F.col("of_chunk") == F.col(CHUNK)) | (F.col(ROW) > F.col("of_chunk") * size - reach))
    return each.withColumn(OWN, F.col("of_chunk") == F.col(CHUNK)).withColumn(CHUNK, F.col("of_chunk")).drop("of_chunk")


def within(keys: list[str]) -> Window:
    """The window over a chunk, in order."""
    return Window.partitionBy(*keys, CHUNK).orderBy(ROW)


def windowed(rows: DataFrame, keys: list[str], order: list[str], size: int, reach: int, compute) -> DataFrame:
    """``compute(rows, window)`` with a window that reaches back at most ``reach`` rows, chunk by chunk.

    ``compute`` has to keep the rows and return the columns it wants plus the three of this module.
    """
    made = compute(with_halo(chunked(rows, keys, order, size), size, reach), within(keys))
    return made.where(OWN).drop(ROW, CHUNK, OWN)


def running(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Chunked ``rows`` with running sums: a column for each of ``values``, from the key's first row up to this one."""
    named = rows.withColumns({f"{n}_part": v for n, v in values.items()})
    per = named.groupBy(*keys, CHUNK).agg(*[F.sum(f"{n}_part").alias(f"{n}_all") for n in values])
    up_to = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    before = per.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(CHUNK).alias("of_chunk"), *[F.coalesce(F.sum(f"{n}_all").over(up_to), F.lit(0)).alias(f"{n}_before") for n in values])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    met = named.join(before, (F.col(CHUNK) == F.col("of_chunk")) & same)
    own = within(keys).rowsBetween(Window.unboundedPreceding, 0)
    return met.select(*rows.columns, *[(F.coalesce(F.sum(f"{n}_part").over(own), F.lit(0)) + F.col(f"{n}_before")).alias(n) for n in values])
