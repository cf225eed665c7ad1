"""Structured Streaming: bars, snapshot deltas with state, deduplication by key.

Each job reads a folder of Parquet files and upserts its results into a table of Parquet files through
``foreachBatch``, so replays of a batch change nothing. ``run_once`` drains what is there and stops; a service would use
a processing-time trigger in its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from ..operators.series import bars
from ..session import shared_dir
from ..sources.keyed_log import KeyedLog

#: What state with timers needs; set while a stream starts, and as before after that. Timers move with the next batch, so a
#: drained stream needs no further batch without data.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Upserts(KeyedLog):
    """A result table that grows by micro-batches, see :class:`KeyedLog`; a batch that is sent again changes nothing.

    All that the sink knows is in the folder: after a restart it goes on from there. Rows replace those with the same keys.
    """

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.has("stream", batch_id):
            batch.write.format("noop").mode("overwrite").save()  # a replay: the table has it, the operators' state may not
        else:
            self.append(batch, "stream", batch_id)


class LatestByKey(Upserts):
    """Keeps the last row per key by an order, over all micro-batches."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], part: Column | None = None):
        super().__init__(spark, folder, keys, part, order)


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream over one table file or over a folder of files, ``files`` of them per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_once(stream: DataFrame, sink: Upserts, mode: str, checkpoint: str) -> None:
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            conf.set(k, v)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stream_bars(ticks: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Bars in update mode; a bar is emitted anew whenever a tick for it comes in before the watermark."""
    return bars(ticks.withWatermark("ts", late), width)


DELTAS = "name long, date date, stars_delta long, forks_delta long, activity_change double, momentum_score double"
STATE = "stars long, forks long, activity_score double, day long"
#: Days for which a repository's last snapshot is kept, as long as staging keeps its rows.
KEPT_DAYS = 30
_DAY_MS = 86_400_000


class Deltas(StatefulProcessor):
    """Deltas of one repository's new snapshots, in order of date; the last snapshot is the state.

    A snapshot that is not later than the last one comes too late: its delta is part of the one that has been given, and it
    is left out. A timer drops the state of a repository that has paused for ``KEPT_DAYS`` days, so the store holds the
    repositories that are alive; one that comes back after that starts from 0, as one does whose staging rows have gone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stars, forks, activity, last = self.last.get() if self.last.exists() else (0, 0, 0.0, None)
        before, out = last, []
        for r in pd.concat(list(rows)).sort_values("date").itertuples():
            day = (pd.Timestamp(r.date) - pd.Timestamp(0)).days
            if last is not None and day <= last:
                continue
            moved, change = int(r.stars) - stars, float(r.activity_score) - activity
            out.append((key[0], r.date, moved, int(r.forks) - forks, change, change * (1.0 if moved >= 0 else -1.0)))
            stars, forks, activity, last = int(r.stars), int(r.forks), float(r.activity_score), day
        if last != before:
            self.last.update((stars, forks, activity, last))
            if before is not None:
                self.handle.deleteTimer((before + KEPT_DAYS) * _DAY_MS)
            self.handle.registerTimer((last + KEPT_DAYS) * _DAY_MS)
        yield pd.DataFrame(out, columns=["name", "date", "stars_delta", "forks_delta", "activity_change", "momentum_score"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_deltas(snapshots: DataFrame) -> DataFrame:
    """Deltas against each repository's snapshot before; rows without a date are left out."""
    dated = snapshots.where("date is not null").withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", f"{KEPT_DAYS} days")
    return dated.groupBy("name").transformWithStateInPandas(Deltas(), StructType.fromDDL(DELTAS), "Append", "EventTime")


def first_by_key(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row per key within the watermark; state is dropped beyond it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
