"""Staging, dimensions, facts and data-quality checks, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.expr import rounded
from ..operators import dims as dm
from ..operators import quality as dq
from ..session import materialised, table
from ..sources import adapters as ad
from ..sources import staging as st
from ..streaming.jobs import shared_folder
from . import core
from .sqlkit import define, oracle, r

KNOWN = "1999-06-30"


def _day(c: str):
    return F.to_date(c)


def scan_staging(spark: SparkSession, sf: str) -> DataFrame:
    """A pruned and filtered scan: two columns of one type of event."""
    return st.read_staging(spark, f"{sf}/events.parquet").where("event_type = 'purchase'").select("event_id", "value")


def retain_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", _day("ts").alias("day"), "ts", "event_id", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return st.append_retain_dedup(old, new, ["user_id", "event_type", "day"], "ts", "2024-01-30", 20, ["ts", "event_id"])


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """(date, ticker, close, volume): last value and number of the events of a day and type."""
    rows = ad.ticks(spark, sf).groupBy(_day("ts").alias("date"), "ticker")
    return rows.agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("volume").alias("volume"))


TICKERS = ["click", "error", "purchase", "signup", "view"]


def _tickers(spark: SparkSession, sf: str) -> list[str]:
    return sorted(x.event_type for x in table(spark, sf, "events").select("event_type").distinct().collect())  # a handful of types


def prices_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return st.prices_to_wide(daily_prices(spark, sf).withColumn("ts", F.col("date")), _tickers(spark, sf), {"Close": "close", "Volume": "volume"})


def prices_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return st.prices_to_long(prices_pivot(spark, sf))


def merge_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = prices_pivot(spark, sf)
    old = wide.where("date <= '2024-01-20'")
    new = wide.where("date >= '2024-01-10'").withColumns({c: F.col(c) + 1 for c in wide.columns if c.startswith("Volume_")})
    return st.prices_to_long(st.merge_wide(old, new))


def dim_time(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of orders, line items and events that are not known yet; those of line items up to a date are known."""
    known = ad.dim_time(spark, sf).where(F.col("date") <= F.lit(KNOWN).cast("date"))
    dates = lambda t, c: table(spark, sf, t).select(_day(c).alias("date"))
    every = dates("lineitem", "l_shipdate").union(dates("orders", "o_orderdate")).union(dates("events", "ts"))
    return dm.calendar(dm.extend_dimension(every, known.select("time_id", "date"), "time_id", ["date"], ["date"]))


def dim_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of parts and suppliers, nations and segments; companies are known."""
    known = ad.dim_entity(spark, sf).where("entity_type = 'company'")
    rows = ad.dim_entity(spark, sf).drop("entity_id")
    named = lambda t, c, k: table(spark, sf, t).select(F.col(c).alias("name"), F.col(c).alias("ticker"), F.lit(k).alias("entity_type"), F.lit("general").alias("industry"))
    every = rows.unionByName(named("nation", "n_name", "research")).unionByName(named("customer", "c_mktsegment", "reddit"))
    return dm.extend_dimension(every, known, "entity_id", ["name"], ["name", "entity_type", "ticker", "industry"])


def dim_source(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded sources and those that the documents name, of which the first six are known."""
    seed = ad.dim_source(spark)
    named = table(spark, sf, "documents").select(F.col("source").alias("source_name"), F.lit("document").alias("source_type")).distinct()
    every = seed.drop("source_id").unionByName(named)
    return dm.extend_dimension(every, seed.where("source_id <= 6"), "source_id", ["source_name"], ["source_name", "source_type"])


def fan_out_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Star join by name only over prices of parts named like a brand or a type: the default that may fan out."""
    lines = ad.sales(spark, sf)
    return dm.star_facts(lines.select("date", "p_brand", "l_quantity"), F.col("date"), F.col("p_brand"), ad.dim_time(spark, sf), ad.dim_entity(spark, sf)).select("time_id", "entity_id", "l_quantity")


def price_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Two facts per price row, those left out that are loaded already (even days)."""
    prices = daily_prices(spark, sf)
    times = dm.number(prices.select("date").distinct(), "time_id", "date")
    entities = dm.number(prices.select(F.col("ticker").alias("name")).distinct(), "entity_id", "name").withColumn("ticker", F.col("name"))
    keyed = dm.star_facts(prices, F.col("date"), F.col("ticker"), times, entities, by="ticker")
    facts = dm.melt_metrics(keyed, {"close": ("stock_price", "USD"), "volume": ("trading_volume", "shares")}, "yfinance")
    loaded = facts.where("time_id % 2 = 0")
    return facts.join(loaded.select("time_id", "entity_id", "metric_name").distinct(), ["time_id", "entity_id", "metric_name"], "left_anti").select("time_id", "entity_id", "metric_name", "metric_value", "metric_unit", "provenance")


def filing_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A fact for the mentions of each filing, and one for its revenue if it names one."""
    rows = ad.filings(spark, sf).select(F.col("doc_id").alias("time_id"), F.col("ticker"), tx.mentions(F.col("filing_text"), ["the", "ai"]).cast("double").alias("mentions"), tx.revenue(F.col("filing_text")).alias("revenue"))
    ids = dm.number(rows.select("ticker").distinct(), "entity_id", "ticker")
    return dm.melt_metrics(rows.join(ids, "ticker"), {"mentions": ("ai_mentions", "count"), "revenue": ("revenue", "USD")}, "sec")


def anti_new_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by key that are not known, with how many share it; one scan of the lines gives both sides."""
    facts, keys = materialised(ad.reality_counts(spark, sf)), ["time_id", "entity_id", "metric_name"]
    known = facts.where("metric_name <> 'trading_volume' and time_id % 3 <> 0").select(*keys)
    return facts.join(known, keys, "left_anti")


def null_aware_anti(spark: SparkSession, sf: str) -> DataFrame:
    """NOT IN against a list with nulls gives nothing, without them the rest: both, by side."""
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    part.createOrReplaceTempView("tidemark_part")
    lines.where("l_quantity > 48").selectExpr("l_partkey", "case when l_linenumber < 7 then l_partkey end as maybe").createOrReplaceTempView("tidemark_taken")
    return spark.sql("""
      SELECT 'plain' AS side, p_partkey FROM tidemark_part WHERE p_partkey NOT IN (SELECT l_partkey FROM tidemark_taken)
      UNION ALL SELECT 'nulls' AS side, p_partkey FROM tidemark_part WHERE p_partkey NOT IN (SELECT maybe FROM tidemark_taken)""")


def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    dates = lambda t, c: table(spark, sf, t).select(_day(c).alias("date"))
    return dates("orders", "o_orderdate").union(dates("lineitem", "l_shipdate")).union(dates("events", "ts")).distinct()


def key_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return dq.key_difference(a, b, ["key"])


def warehouse_counts(spark: SparkSession, sf: str) -> DataFrame:
    facts, real = ad.hype_facts(spark, sf), ad.reality_facts(spark, sf)
    return dq.row_counts({"dim_time": ad.dim_time(spark, sf), "dim_entity": ad.dim_entity(spark, sf), "fact_hype_signals": facts, "fact_reality_signals": real})


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as staged against facts as loaded, by source; the staged side also has rows without an entity."""
    staged = ad.hype_signals(ad.sales(spark, sf)).select("source_name", F.col("name").alias("entity"))
    sources = ad.dim_source(spark)
    loaded = ad.hype_facts(spark, sf).where("time_id % 10 <> 0").join(F.broadcast(sources), "source_id").join(ad.dim_entity(spark, sf), "entity_id").select("source_name", F.col("name").alias("entity"))
    return dq.reconcile(staged, loaded, "source_name", "entity")


def null_keys(spark: SparkSession, sf: str) -> DataFrame:
    facts = ad.reality_facts(spark, sf).select(F.when(F.col("time_id") % 50 != 0, F.col("time_id")).alias("time_id"), F.when(F.col("metric_value") >= 0, F.col("entity_id")).alias("entity_id"))
    return dq.null_keys(facts, ["time_id", "entity_id"], "fact_reality_signals")


def signals_by_source(spark: SparkSession, sf: str) -> DataFrame:
    per = ad.hype_facts(spark, sf).groupBy("source_id").agg(F.count("*").alias("signals"), F.count_distinct("entity_id").alias("entities"))
    return per.join(F.broadcast(ad.dim_source(spark)), "source_id").select("source_name", "source_type", "signals", "entities")


def duplicate_dates(spark: SparkSession, sf: str) -> DataFrame:
    return dq.duplicates(table(spark, sf, "events").select("user_id", _day("ts").alias("date")), ["user_id", "date"])


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", _day("ts").alias("date"), "event_id", "value")
    return dq.duplicate_rows(rows, ["user_id", "event_type", "date"], ["event_id"], 3)


def price_completeness(spark: SparkSession, sf: str) -> DataFrame:
    p = daily_prices(spark, sf).withColumns({"close": F.when(F.col("close") > 5, F.col("close")), "volume": F.when(F.col("volume") > 20, F.col("volume"))})
    has = lambda *cs: F.count_if(F.lit(True) if not cs else sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)) == len(cs))
    return p.groupBy("ticker").agg(has().alias("n"), has("close").alias("with_close"), has("volume").alias("with_volume"), has("close", "volume").alias("with_both"), F.count_distinct("date").alias("dates"))


def entities_per_date(spark: SparkSession, sf: str) -> DataFrame:
    return core.daily_hype(spark, sf).groupBy("date").agg(F.count_distinct("entity_id").alias("entities"))


def assign_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return dm.assign_keys(orders, "row_key", ["o_custkey", "o_orderkey"], start=1000)


def _round_trip(write, read):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = shared_folder(spark, "staging")
        write(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
        return read(spark, path)

    return run


def _history(df: DataFrame, path: str) -> None:
    for kind in ("click", "view"):
        st.history_store(df.where(F.col("event_type") == kind), path, "events", kind)
    st.history_store(df.where("event_type = 'click' and value > 1"), path, "events", "click")


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema's tables created, filled by replace and append, counted, and dropped."""
    name = f"tidemark_{uuid.uuid4().hex[:10]}"
    st.create_schema(spark, name)
    st.append_table(ad.dim_time(spark, sf).select("time_id", "date", "unix_ts", "week", "month", "year", "is_business_day"), f"{name}.dim_time")
    daily = core.daily_hype(spark, sf)
    st.replace_table(daily.where("entity_type = 'software'"), f"{name}.daily")
    st.append_table(daily.where("entity_type = 'company'"), f"{name}.daily")
    counts = [(t, spark.table(f"{name}.{t}").count()) for t in ("dim_time", "daily")]  # two numbers
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame(counts, "table_name string, n long")


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {
    "scan_staging": scan_staging,
    "retain_dedup": retain_dedup,
    "prices_pivot": prices_pivot,
    "prices_unpivot": prices_unpivot,
    "merge_wide": merge_wide,
    "dim_time": dim_time,
    "dim_entity": dim_entity,
    "dim_source": dim_source,
    "assign_keys": assign_keys,
    "hype_facts": lambda s, d: ad.hype_facts(s, d).groupBy("time_id", "entity_id", "source_id", "signal_type", "metric_name").agg(F.count("*").alias("n"), F.sum("metric_value").alias("total")),
    "reality_facts": lambda s, d: ad.reality_facts(s, d).groupBy("time_id", "entity_id", "metric_name", "metric_unit", "provenance").agg(F.count("*").alias("n"), F.sum("metric_value").alias("total")),
    "fan_out_facts": fan_out_facts,
    "price_facts": price_facts,
    "filing_facts": filing_facts,
    "anti_new_facts": anti_new_facts,
    "null_aware_anti": null_aware_anti,
    "union_distinct": union_distinct,
    "key_diff": key_diff,
    "warehouse_counts": warehouse_counts,
    "reconcile": reconcile,
    "null_keys": null_keys,
    "signals_by_source": signals_by_source,
    "duplicate_dates": duplicate_dates,
    "duplicate_rows": duplicate_rows,
    "sample_buckets": lambda s, d: dq.sample_buckets(ad.daily_events(s, d), "entity_id"),
    "coverage": lambda s, d: dq.coverage(core.daily_hype(s, d), "entity_id", "date"),
    "freshness": lambda s, d: dq.freshness(table(s, d, "events").select("event_type", _day("ts").alias("date")), "event_type", "date", "2024-01-30"),
    "price_completeness": price_completeness,
    "entities_per_date": entities_per_date,
    "write_staging": _round_trip(st.write_staging, st.read_staging),
    "raw_json": _round_trip(st.write_raw_json, lambda s, p: st.read_raw_json(s, p, "event_id long, event_type string, value double")),
    "history_store": _round_trip(_history, st.read_staging),
    "create_schema": _tables,
}.items()}

define("dprice", "SELECT CAST(ts AS DATE) AS date, event_type AS ticker, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL")
_EV = "SELECT event_id, event_type, round(value + 1.37e-9, 6) + 0.0 AS value FROM events"
_WIDE = ", ".join(f"round(max({c}) FILTER (ticker = '{t}') + 1.37e-9, 6) + 0.0 AS {n}_{t}" for t in TICKERS for n, c in (("Close", "close"), ("Volume", "volume")))

ORACLE_SQL = {
    "scan_staging": f"SELECT event_id, {r('value')} FROM events WHERE event_type = 'purchase'",
    "retain_dedup": f"SELECT user_id, event_type, CAST(ts AS DATE) AS day, ts, event_id, {r('value')} FROM events WHERE ts >= DATE '2024-01-30' - 20 QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1",
    "prices_unpivot": oracle(f"SELECT date, ticker, {r('close', 'volume')} FROM dprice"),
    "merge_wide": oracle(f"SELECT date, ticker, {r('close')}, round(volume + CASE WHEN date >= DATE '2024-01-10' THEN 1 ELSE 0 END + 1.37e-9, 6) + 0.0 AS volume FROM dprice"),
    "dim_time": oracle(f"""
SELECT (SELECT max(time_id) FROM times WHERE date <= DATE '{KNOWN}') + row_number() OVER (ORDER BY date) AS time_id, date, CAST(epoch(date) AS BIGINT) AS unix_ts, CAST(week(date) AS INT) AS week, CAST(month(date) AS INT) AS month,
  CAST(year(date) AS INT) AS year, dayofweek(date) NOT IN (0, 6) AS is_business_day
FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem UNION SELECT CAST(o_orderdate AS DATE) FROM orders UNION SELECT CAST(ts AS DATE) FROM events)
WHERE date IS NOT NULL AND date NOT IN (SELECT date FROM times WHERE date <= DATE '{KNOWN}')"""),
    "dim_entity": oracle("""
SELECT (SELECT max(entity_id) FROM entities WHERE entity_type = 'company') + row_number() OVER (ORDER BY name, entity_type, ticker, industry) AS entity_id, name, ticker, entity_type, industry FROM (
  SELECT name, ticker, entity_type, industry FROM entities UNION SELECT n_name, n_name, 'research', 'general' FROM nation UNION SELECT c_mktsegment, c_mktsegment, 'reddit', 'general' FROM customer)
WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM entities WHERE entity_type = 'company')"""),
    "dim_source": oracle("""
SELECT 6 + row_number() OVER (ORDER BY source_name, source_type) AS source_id, source_name, source_type FROM (SELECT source_name, source_type FROM sources UNION SELECT source, 'document' FROM documents)
WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM sources WHERE source_id <= 6)"""),
    "assign_keys": "SELECT o_custkey, o_orderkey, 1000 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_key FROM orders",
    "hype_facts": oracle("SELECT time_id, entity_id, source_id, signal_type, metric_name, count(*) AS n, round(sum(metric_value) + 1.37e-9, 6) + 0.0 AS total FROM hfacts GROUP BY ALL"),
    "reality_facts": oracle("SELECT time_id, entity_id, metric_name, metric_unit, provenance, count(*) AS n, round(sum(metric_value) + 1.37e-9, 6) + 0.0 AS total FROM rfacts GROUP BY ALL"),
    "fan_out_facts": oracle("SELECT time_id, entity_id, round(q + 1.37e-9, 6) + 0.0 AS l_quantity FROM sold JOIN times USING (date) JOIN entities ON brand = name"),
    "price_facts": oracle("""
SELECT * FROM (SELECT t.time_id, e.entity_id, m.metric_name, round(CASE m.metric_name WHEN 'stock_price' THEN close ELSE volume END + 1.37e-9, 6) + 0.0 AS metric_value, m.metric_unit, 'yfinance' AS provenance
  FROM dprice p JOIN (SELECT date, row_number() OVER (ORDER BY date) AS time_id FROM (SELECT DISTINCT date FROM dprice)) t USING (date)
  JOIN (SELECT ticker, row_number() OVER (ORDER BY ticker) AS entity_id FROM (SELECT DISTINCT ticker FROM dprice)) e USING (ticker), (VALUES ('stock_price', 'USD'), ('trading_volume', 'shares')) m(metric_name, metric_unit))
WHERE time_id % 2 <> 0 AND metric_value IS NOT NULL"""),
    "filing_facts": """
SELECT doc_id AS time_id, entity_id, metric_name, round(v + 1.37e-9, 6) + 0.0 AS metric_value, metric_unit, 'sec' AS provenance FROM (
  SELECT doc_id, source, 'ai_mentions' AS metric_name, contains(lower(text), 'the')::INT + contains(lower(text), 'ai')::INT AS v, 'count' AS metric_unit FROM documents
  UNION ALL SELECT doc_id, source, 'revenue', CASE WHEN doc_id % 2 = 0 THEN n_chars * 1e6 ELSE 1234.0 END, 'USD' FROM documents)
JOIN (SELECT source, row_number() OVER (ORDER BY source) AS entity_id FROM (SELECT DISTINCT source FROM documents)) USING (source)""",
    "anti_new_facts": oracle("SELECT time_id, entity_id, metric_name, count(*) AS n FROM rfacts WHERE metric_name = 'trading_volume' OR time_id % 3 = 0 GROUP BY ALL"),
    "null_aware_anti": "SELECT 'plain' AS side, p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "union_distinct": "SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events",
    "key_diff": """
SELECT key, 'only_first' AS side FROM (SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT key, 'only_second' FROM (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)""",
    "warehouse_counts": oracle("SELECT 'dim_time' AS table_name, count(*) AS n FROM times UNION ALL SELECT 'dim_entity', count(*) FROM entities UNION ALL SELECT 'fact_hype_signals', count(*) FROM hfacts UNION ALL SELECT 'fact_reality_signals', count(*) FROM rfacts"),
    "reconcile": oracle("""
SELECT source_name, coalesce(a, 0) AS staging_rows, coalesce(b, 0) AS staging_entities, coalesce(c, 0) AS warehouse_rows, coalesce(d, 0) AS warehouse_entities, coalesce(a, 0) - coalesce(c, 0) AS missing_rows
FROM (SELECT source_name, count(*) AS a, count(DISTINCT name) AS b FROM hype_signals JOIN sources USING (source_id) WHERE v IS NOT NULL GROUP BY ALL)
FULL JOIN (SELECT source_name, count(*) AS c, count(DISTINCT name) AS d FROM hfacts JOIN sources USING (source_id) JOIN entities USING (entity_id) WHERE time_id % 10 <> 0 GROUP BY ALL) USING (source_name)"""),
    "null_keys": oracle("SELECT 'fact_reality_signals' AS table_name, 'time_id' AS column_name, count(*) FILTER (time_id % 50 = 0) AS nulls FROM rfacts UNION ALL SELECT 'fact_reality_signals', 'entity_id', count(*) FILTER (metric_value < 0) FROM rfacts"),
    "signals_by_source": oracle("SELECT source_name, source_type, count(*) AS signals, count(DISTINCT entity_id) AS entities FROM hfacts JOIN sources USING (source_id) GROUP BY ALL"),
    "duplicate_dates": "SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "duplicate_rows": f"SELECT * FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS date, event_id, {r('value')}, count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS copies, CAST(row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS INT) AS rn FROM events) WHERE copies > 1 AND rn <= 3",
    "sample_buckets": oracle("SELECT CASE WHEN n < 5 THEN 'under 5' WHEN n < 10 THEN '5 to 9' WHEN n < 30 THEN '10 to 29' ELSE '30 and more' END AS bucket, count(*) AS keys, sum(n)::BIGINT AS samples FROM (SELECT entity_id, count(*) AS n FROM ev GROUP BY entity_id) GROUP BY ALL"),
    "coverage": oracle("SELECT entity_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, CAST(max(date) - min(date) AS INT) AS span_days, count(DISTINCT date) AS dates FROM dhype GROUP BY entity_id"),
    "freshness": "SELECT event_type, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, CAST(DATE '2024-01-30' - max(CAST(ts AS DATE)) AS INT) AS days_old, max(CAST(ts AS DATE)) = DATE '2024-01-30' AS has_today FROM events GROUP BY ALL",
    "price_completeness": oracle("SELECT ticker, count(*) AS n, count(*) FILTER (close > 5) AS with_close, count(*) FILTER (volume > 20) AS with_volume, count(*) FILTER (close > 5 AND volume > 20) AS with_both, count(DISTINCT date) AS dates FROM dprice GROUP BY ticker"),
    "entities_per_date": oracle("SELECT date, count(DISTINCT entity_id) AS entities FROM dhype GROUP BY date"),
    "write_staging": _EV,
    "raw_json": _EV,
    "history_store": "SELECT event_id, event_type, round(value + 1.37e-9, 6) + 0.0 AS value, 'events' AS data_type, event_type AS timeframe FROM events WHERE event_type = 'view' OR (event_type = 'click' AND value > 1)",
    "create_schema": oracle("SELECT 'dim_time' AS table_name, count(*) AS n FROM times UNION ALL SELECT 'daily', count(*) FROM dhype WHERE entity_type IN ('software', 'company')"),
    "prices_pivot": oracle(f"SELECT date, {_WIDE} FROM dprice GROUP BY date"),
}
