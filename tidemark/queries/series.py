"""Bars, snapshot deltas and streams over events, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import intervals as iv
from ..operators import quantiles as qt
from ..operators import series as sr
from ..session import table
from ..sources import adapters as ad
from ..sources.keyed_log import KeyedLog
from ..sources.staging import keep_latest
from ..streaming import jobs
from . import text as _text  # defines the snapshots' SQL  # noqa: F401
from .sqlkit import define, oracle, r

MIDDLE = "2024-01-15"


#: A micro-batch takes all files of an arrival.
ALL_FILES = 1_000_000


def _arrivals(df: DataFrame, day: str) -> list[DataFrame]:
    """Two arrivals, one after the other; rows without a day come with the second."""
    first = F.coalesce(F.col(day) < F.lit(MIDDLE).cast("date"), F.lit(False))
    return [df.where(first), df.where(~first)]


def _streamed(spark: SparkSession, rows: DataFrame, day: str, job, keys: list[str], mode: str, sink=None, part: str | None = None) -> DataFrame:
    """The job's table after both arrivals, each written in the partitions that it comes in and drained before the next.

    The sink is made anew for each arrival, as after a restart.
    """
    folder = jobs.shared_folder(spark, "stream")
    for arrival in _arrivals(rows, day):
        out = (sink or jobs.Upserts)(spark, f"{folder}/out", keys, *([F.to_date(part)] if part else []))
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream = job(jobs.source(spark, f"{folder}/in", rows.schema, ALL_FILES))
        jobs.run_once(stream, out, mode, f"{folder}/checkpoint")
    return out.table(stream.schema)


def stream_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, ad.ticks(spark, sf), "ts", lambda s: jobs.stream_bars(s, "1 hour", "40 days"), ["ticker", "bucket"], "update", part="bucket")


def stream_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.snapshots(spark, sf).select("name", "date", "stars", "forks", "activity_score")
    return _streamed(spark, rows, "date", jobs.stream_deltas, ["name", "date"], "append", part="date")


def _daily_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "value")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    sink = lambda s, folder, keys, part: jobs.LatestByKey(s, folder, keys, ["ts", "event_id"], part)
    return _streamed(spark, _daily_keys(spark, sf), "day", lambda s: s, ["user_id", "event_type", "day"], "append", sink, "day")


def newer_than_hwm(spark: SparkSession, sf: str) -> DataFrame:
    """Events after their type's mark; marks are the last events of the first half of the month, none for errors."""
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    marks = events.where((F.col("ts") < F.lit(MIDDLE).cast("timestamp")) & (F.col("event_type") != "error")).groupBy("event_type").agg(F.max("ts").alias("last"))
    return sr.newer_than(events, marks, "event_type", "ts")


def stored_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Events loaded by stored marks: those of the first half of the month, all, and all once more. Each is there once."""
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    store = KeyedLog(spark, jobs.shared_folder(spark, "marks"), ["event_id", "ts"], F.to_date("ts"))
    for rows in (events.where(F.col("ts") < F.lit(MIDDLE).cast("timestamp")), events, events):

        def choose(marks: dict[str, str], rows: DataFrame = rows) -> DataFrame:
            known = spark.createDataFrame(list(marks.items()), "event_type string, last string").withColumn("last", F.col("last").cast("timestamp"))
            return sr.newer_than(rows, known, "event_type", "ts")

        store.ingest(choose, "event_type", "ts")
    return store.table(events.schema)


#: Microseconds of an hour.
HOUR = 3_600_000_000


def trailing_sums(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the user's events of the 1 to 72 hours up to it, by its id: intervals of any lengths."""
    events = table(spark, sf, "events")
    stop = F.unix_micros(F.col("ts").cast("timestamp"))
    start = stop - (1 + F.col("event_id") % 72) * HOUR
    asked = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return iv.interval_sums(events, asked, "user_id", stop, F.col("value"), start, stop, 6 * HOUR, hot=1_000)


def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of the values of each type of event, by passes that leave at most 100 values of a type to be sorted."""
    return qt.exact_quantiles(table(spark, sf, "events"), "event_type", "value", [0.25, 0.5, 0.75], 100)


def due_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Which users have not been seen for a day, six hours or an hour, by their id modulo 3."""
    events = table(spark, sf, "events")
    status = events.where("user_id % 7 <> 0").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last"))
    minutes = events.select(F.col("user_id").alias("source")).distinct().withColumn("minutes", F.element_at(F.array(F.lit(1440), F.lit(360), F.lit(60)), (F.col("source") % 3 + 1).cast("int")))
    return sr.due_sources(status, minutes, "2024-01-31 00:00:00").select("source", "last", "due")


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {
    "ohlcv_10m": lambda s, d: sr.fill_bars(sr.bars(ad.ticks(s, d), "10 minutes"), "10 minutes"),
    "ohlcv_1h": lambda s, d: sr.bars(ad.ticks(s, d), "1 hour"),
    "ohlcv_1d": lambda s, d: sr.bars(ad.ticks(s, d), "1 day"),
    "repo_deltas": lambda s, d: sr.repo_deltas(ad.snapshots(s, d)),
    "model_deltas": lambda s, d: sr.model_deltas(ad.snapshots(s, d)),
    "stream_ohlcv": stream_ohlcv,
    "stream_deltas": stream_deltas,
    "stream_dedup": stream_dedup,
    "newer_than_hwm": newer_than_hwm,
    "stored_marks": stored_marks,
    "due_sources": due_sources,
    "trailing_sums": trailing_sums,
    "exact_quantiles": exact_quantiles,
    "dedup_latest": lambda s, d: keep_latest(_daily_keys(s, d), ["user_id", "event_type", "day"], ["ts", "event_id"]),
}.items()}


def _bars(width: str) -> str:
    return f"SELECT event_type AS ticker, time_bucket(INTERVAL '{width}', ts) AS bucket, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL"


_OHLC = ["open", "high", "low", "close", "volume"]
define("bars10", _bars("10 minutes"))
define("spine10", "SELECT ticker, unnest(generate_series(a, b, INTERVAL '10 minutes')) AS bucket FROM (SELECT ticker, min(bucket) AS a, max(bucket) AS b FROM bars10 GROUP BY ticker)")
define("latest_key", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
_RD = "SELECT name, date, stars_delta, forks_delta, round(activity_change + 1.37e-9, 6) + 0.0 AS activity_change, round(momentum_score + 1.37e-9, 6) + 0.0 AS momentum_score FROM rmom"
_LAG = lambda c: f"coalesce(lag({c}) OVER (PARTITION BY name ORDER BY date), 0)"

ORACLE_SQL = {
    "ohlcv_10m": oracle(f"SELECT ticker, bucket, {r(*_OHLC[:4])}, round(coalesce(volume, 0) + 1.37e-9, 6) + 0.0 AS volume FROM spine10 LEFT JOIN bars10 USING (ticker, bucket)"),
    "ohlcv_1h": f"SELECT ticker, bucket, {r(*_OHLC)} FROM ({_bars('1 hour')})",
    "ohlcv_1d": f"SELECT ticker, bucket, {r(*_OHLC)} FROM ({_bars('1 day')})",
    "stream_ohlcv": f"SELECT ticker, bucket, {r(*_OHLC)} FROM ({_bars('1 hour')})",
    "repo_deltas": oracle(_RD),
    "stream_deltas": oracle(_RD),
    "model_deltas": oracle(f"SELECT name, date, CAST(downloads - {_LAG('downloads')} AS BIGINT) AS downloads_delta, CAST(likes - {_LAG('likes')} AS BIGINT) AS likes_delta, round((downloads - {_LAG('downloads')}) / greatest({_LAG('downloads')}, 1) * 0.6 + (likes - {_LAG('likes')}) / greatest({_LAG('likes')}, 1) * 0.4 + 1.37e-9, 6) + 0.0 AS trending_score FROM snaps"),
    "stream_dedup": oracle(f"SELECT user_id, event_type, day, ts, event_id, {r('value')} FROM latest_key"),
    "dedup_latest": oracle(f"SELECT user_id, event_type, day, ts, event_id, {r('value')} FROM latest_key"),
    "trailing_sums": f"SELECT event_id, user_id, ts, n_points, {r('total')} FROM (SELECT a.event_id, a.user_id, a.ts, count(*) AS n_points, sum(b.value) AS total FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - to_hours((1 + a.event_id % 72)::INT) AND a.ts WHERE a.event_type = 'purchase' GROUP BY ALL)",
    "exact_quantiles": f"SELECT event_type, prob, n, {r('quantile')} FROM (" + " UNION ALL ".join(f"SELECT event_type, {p}::DOUBLE AS prob, count(value) AS n, quantile_cont(value, {p}) AS quantile FROM events GROUP BY event_type" for p in (0.25, 0.5, 0.75)) + ")",
    "stored_marks": "SELECT event_id, event_type, ts FROM events",
    "newer_than_hwm": f"SELECT e.event_id, e.event_type, e.ts FROM events e LEFT JOIN (SELECT event_type, max(ts) AS last FROM events WHERE ts < TIMESTAMP '{MIDDLE}' AND event_type <> 'error' GROUP BY ALL) m USING (event_type) WHERE last IS NULL OR ts > last",
    "due_sources": "SELECT source, last, coalesce(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last)) >= 60 * CASE source % 3 WHEN 0 THEN 1440 WHEN 1 THEN 360 ELSE 60 END, true) AS due FROM (SELECT DISTINCT user_id AS source FROM events) LEFT JOIN (SELECT user_id AS source, max(ts) AS last FROM events WHERE user_id % 7 <> 0 GROUP BY ALL) USING (source)",
}
