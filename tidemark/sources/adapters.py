"""The sales, events and text tables read as signals, so that every operator runs on the given data.

All metrics are integers or integers over a power of two: sums are then exact in any order, and ratios of them
agree between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import calendar, counted, member_keys
from ..session import materialised, spread, table
from .schemas import SOURCES

_PERCENT = lambda c: F.round(F.col(c) * 100)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return joined.withColumn("date", F.to_date("l_shipdate"))


def _signals(base: DataFrame, rows: list[tuple[str, Column, str, str, str, Column]]) -> DataFrame:
    """One scan: every line yields its signals as (date, entity_type, name, source_name, kind, metric_name, metric_value)."""
    structs = [
        F.struct(F.lit(t).alias("entity_type"), n.alias("name"), F.lit(s).alias("source_name"), F.lit(k).alias("kind"), F.lit(m).alias("metric_name"), v.cast("double").alias("metric_value"))
        for t, n, s, k, m, v in rows
    ]
    return base.select("date", F.inline(F.array(*structs))).where("metric_value is not null")


def hype_signals(base: DataFrame) -> DataFrame:
    return _signals(base, _hype_rows())


def _hype_rows() -> list[tuple[str, Column, str, str, str, Column]]:
    nation, size = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")), F.concat(F.lit("size-"), (F.col("p_size") % 5).cast("string"))
    innovation = _PERCENT("l_discount") / 16
    return [
        ("company", F.col("p_brand"), "reddit", "sentiment", "reddit_ai_sentiment", F.when(F.col("l_returnflag") != "N", (2 * _PERCENT("l_discount") - 9) / 16)),
        ("company", F.col("p_brand"), "news", "sentiment", "news_ai_sentiment", F.when(F.col("l_linestatus") == "O", (2 * _PERCENT("l_tax") - 7) / 16)),
        ("software", F.col("p_type"), "github", "trending", "github_trending_score", F.col("l_quantity") / 64),
        ("ai_model", nation, "huggingface", "trending", "huggingface_trending_score", F.col("l_quantity") / 64),
        ("ai_model", nation, "arxiv", "innovation", "arxiv_innovation_score", innovation),
        ("research", size, "arxiv", "innovation", "arxiv_innovation_score", innovation),
    ]


def reality_signals(base: DataFrame) -> DataFrame:
    return _signals(base, _reality_rows())


def _reality_rows() -> list[tuple[str, Column, str, str, str, Column]]:
    nation = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"))
    return [
        ("company", F.col("p_brand"), "yfinance", "USD", "stock_price", F.round(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))),
        ("company", F.col("p_brand"), "yfinance", "shares", "trading_volume", F.col("l_quantity")),
        ("software", F.col("p_type"), "github", "count", "github_stars_delta", F.col("l_quantity") - 25),
        ("software", F.col("p_type"), "github", "count", "github_forks_delta", F.col("l_linenumber") - 3),
        ("ai_model", nation, "huggingface", "count", "model_downloads_delta", F.col("l_quantity") - 25),
    ]


def daily_signals(base: DataFrame) -> DataFrame:
    """Per entity and day the average and count of every hype and reality metric, as ``<metric>`` and ``<metric>_n``; one scan.

    The types of entities are the grouping sets of one aggregation, and hype and reality lie side by side.
    """
    listed = [(t, n, m, v) for rows in (_hype_rows(), _reality_rows()) for t, n, _, _, m, v in rows]
    names, values = {t: n for t, n, _, _ in listed}, {m: v for _, _, m, v in listed}
    each = base.select("date", *[n.alias(t) for t, n in names.items()], *[v.cast("double").alias(m) for m, v in values.items()])
    sets = each.groupingSets([["date", t] for t in names], "date", *names)
    met = sets.agg(*[F.grouping(t).alias(f"{t}_off") for t in names], *[f(m).alias(m + n) for m in values for f, n in ((F.avg, ""), (F.count, "_n"))])
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t in names:
        kind, name = F.when(F.col(f"{t}_off") == 0, F.lit(t)).otherwise(kind), F.when(F.col(f"{t}_off") == 0, F.col(t)).otherwise(name)
    out = met.select(kind.alias("entity_type"), name.alias("name"), "date", *[m + n for m in values for n in ("", "_n")])
    of = {m: [t for t, _, x, _ in listed if x == m] for m in values}
    held = lambda m: F.col("entity_type").isin(of[m])
    return out.select("entity_type", "name", "date", *[c for m in values for c in (F.when(held(m), F.col(m)).alias(m), F.when(held(m), F.col(f"{m}_n")).otherwise(0).alias(f"{m}_n"))])


def dim_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(member_keys(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).where("date is not null").distinct(), "time_id", "date"))


def dim_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    named = lambda df, name, kind, industry: df.select(name.alias("name"), name.alias("ticker"), F.lit(kind).alias("entity_type"), F.lit(industry).alias("industry")).distinct()
    all_kinds = (
        named(part, F.col("p_brand"), "company", "technology")
        .unionByName(named(part, F.col("p_type"), "software", "ai_infrastructure"))
        .unionByName(named(table(spark, sf_dir, "supplier"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")), "ai_model", "general"))
        .unionByName(named(part, F.concat(F.lit("size-"), (F.col("p_size") % 5).cast("string")), "research", "academic"))
    )
    return member_keys(all_kinds.where("name is not null").distinct(), "entity_id", "name", "entity_type", "ticker", "industry")


def dim_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, n, t) for i, (n, t) in enumerate(SOURCES)], "source_id int, source_name string, source_type string")


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The time and entity dimensions, built once; without them each use would scan the line items again."""
    return materialised(dim_time(spark, sf_dir)), materialised(dim_entity(spark, sf_dir))


def _keyed(signals: DataFrame, dims: tuple[DataFrame, DataFrame]) -> DataFrame:
    times, entities = dims
    return signals.join(counted(times.select("time_id", "date")), "date").join(counted(entities.select("entity_id", "name", "entity_type")), ["name", "entity_type"])


def hype_facts(spark: SparkSession, sf_dir: str, dims: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time_id, entity_id, source_id, signal_type, metric_name, metric_value), one row per signal."""
    keyed = _keyed(hype_signals(sales(spark, sf_dir)), dims or star(spark, sf_dir)).join(F.broadcast(dim_source(spark)), "source_name")  # as many rows as SOURCES has
    return keyed.select("time_id", "entity_id", "source_id", F.col("kind").alias("signal_type"), "metric_name", "metric_value")


def reality_facts(spark: SparkSession, sf_dir: str, dims: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    keyed = _keyed(reality_signals(sales(spark, sf_dir)), dims or star(spark, sf_dir))
    return keyed.select("time_id", "entity_id", "metric_name", "metric_value", F.col("kind").alias("metric_unit"), F.col("source_name").alias("provenance"))


def reality_counts(spark: SparkSession, sf_dir: str, dims: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time_id, entity_id, metric_name, n): how many of :func:`reality_facts` share these keys; signals are counted before they are keyed."""
    per_day = reality_signals(sales(spark, sf_dir)).groupBy("date", "name", "entity_type", "metric_name").agg(F.count("*").alias("n"))
    return _keyed(per_day, dims or star(spark, sf_dir)).groupBy("time_id", "entity_id", "metric_name").agg(F.sum("n").alias("n"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, date, hype, reality): per user and active day the views and clicks, and the purchases."""
    events = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return events.groupBy(F.col("user_id").alias("entity_id"), "date").agg(
        F.count_if(F.col("event_type").isin("view", "click")).cast("double").alias("hype"), F.count_if(F.col("event_type") == "purchase").cast("double").alias("reality")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, seq, price, volume) from events."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.col("source").alias("company"), _day_of_doc().alias("published"), F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("description"), F.col("lang").alias("source"), _address("doc").alias("url"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", F.col("role").alias("subreddit"), (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_utc"), F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("selftext"), (F.length("text") % 100 - 1).cast("long").alias("score"), F.col("turn").alias("num_comments"),
        F.concat(F.lit("post/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"),
    )


def _day_of_doc() -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))


def _address(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col("doc_id").cast("string"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("search_term"), F.col("text").alias("abstract"), (F.col("doc_id") % 7).cast("int").alias("n_authors"), _day_of_doc().alias("published"), _address("paper").alias("url")
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.concat(F.lit("Revenue was $"), F.col("n_chars").cast("string"), F.lit(" million. "), F.col("text"))
    odd = F.concat(F.lit("Revenue of 1,234 "), F.col("text"))
    form = F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("ticker"), F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd).alias("filing_text"), form.alias("form"), _day_of_doc().alias("filed"), _address("filing").alias("url")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, date, stars, forks, activity_score, downloads, likes): running totals per user and active day."""
    from pyspark.sql import Window

    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "click").alias("clicks")
    )
    w = Window.partitionBy("user_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        F.col("user_id").alias("name"), "date", F.sum("n").over(w).alias("stars"), F.sum("purchases").over(w).alias("forks"), F.col("n").cast("double").alias("activity_score"),
        (F.sum("n").over(w) * 10).alias("downloads"), F.sum("clicks").over(w).alias("likes"),
    )
