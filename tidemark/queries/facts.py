"""Loads of facts with their texts and addresses, strict lookups, and two small record features, with oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.expr import rounded
from ..operators import dims as dm
from ..session import materialised, remove, table
from ..sources import adapters as ad
from ..streaming.jobs import shared_folder
from .sqlkit import define, oracle, r_as
from .text import GROUPS, IMPACT, LEXICON, TERMS

AS_OF = "2024-03-30"


def _scored(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the sentiment of their texts, which are read where they are."""
    signed = lambda sign: [t for t, v in LEXICON.items() if v * sign > 0]
    return rows.withColumns({"sentiment": tx.compound_of(text, LEXICON), "pos": tx.share_of(text, signed(1)), "neg": tx.share_of(text, signed(-1))})


def text_signals(spark: SparkSession, sf: str) -> DataFrame:
    """(date, name, source_name, signal_type, metric_name, metric_value, raw_text, url) of posts, articles, papers and filings."""
    posts = tx.post_features(_scored(ad.posts(spark, sf), F.col("selftext")), TERMS)
    news = tx.news_features(_scored(ad.news(spark, sf), F.concat_ws(" ", "title", "description")), TERMS)
    papers = tx.paper_features(ad.papers(spark, sf), GROUPS, TERMS, IMPACT)
    filings = tx.ai_sentences(_scored(ad.filings(spark, sf), F.col("filing_text")), "filing_text", TERMS)
    both = lambda a, b: F.concat(F.col(a), F.lit(" "), F.col(b))
    parts = [
        (posts, F.to_date(F.timestamp_seconds("created_utc")), "subreddit", "reddit", "sentiment", "reddit_ai_sentiment", "ai_sentiment_score", both("title", "selftext")),
        (news, F.col("published"), "company", "news", "sentiment", "news_ai_sentiment", "ai_sentiment_score", both("title", "description")),
        (papers, F.col("published"), "search_term", "arxiv", "innovation", "arxiv_innovation_score", "impact_score", F.col("abstract")),
        (filings, F.col("filed"), "ticker", "sec", "sentiment", "sec_filing_sentiment", "sentiment", F.array_join("ai_mentions", "\n")),
    ]
    one = lambda df, day, name, source, kind, metric, value, raw: df.select(
        day.alias("date"), F.col(name).alias("name"), F.lit(source).alias("source_name"), F.lit(kind).alias("signal_type"), F.lit(metric).alias("metric_name"),
        F.col(value).cast("double").alias("metric_value"), raw.alias("raw_text"), "url",
    )
    first, *rest = [one(*p) for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first.where("metric_value is not null")


def _dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, turns = table(spark, sf, "documents"), table(spark, sf, "conversations")
    names = docs.select(F.col("source").alias("name")).union(docs.select("lang")).union(turns.select("role")).where("name is not null").distinct()
    days = ad.papers(spark, sf).select(F.col("published").alias("date")).union(ad.posts(spark, sf).select(F.to_date(F.timestamp_seconds("created_utc")))).where("date is not null").distinct()
    return materialised(dm.number(days, "time_id", "date")), materialised(dm.number(names, "entity_id", "name"))


def hype_load(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table after three loads: of the even days, of all days, and of all days again."""
    times, entities = _dims(spark, sf)
    keyed = dm.star_facts(text_signals(spark, sf), F.col("date"), F.col("name"), times, entities)
    facts = dm.lookup(keyed, "source_name", ad.dim_source(spark), "source_name", "source_id").select("time_id", "entity_id", "source_id", "signal_type", "metric_name", "metric_value", "raw_text", "url")
    path, keys = shared_folder(spark, "hype-facts"), ["time_id", "entity_id", "source_id", "url"]
    batch = shared_folder(spark, "hype-batch")
    facts.write.option("compression", "zstd").parquet(batch)  # texts are analysed once; what a load compares are four columns of this
    facts = spark.read.parquet(batch)
    for some in (facts.where("time_id % 2 = 0"), facts, facts):
        dm.append_facts(some, path, keys)
    remove(spark, batch)
    return spark.read.parquet(path)


def filing_load(spark: SparkSession, sf: str) -> DataFrame:
    """Revenues of filings, by strict lookups of the day and the ticker, loaded twice. Filings without a ticker are left out."""
    times, entities = _dims(spark, sf)
    rows = ad.filings(spark, sf).withColumn("revenue", tx.revenue(F.col("filing_text"))).where("ticker is not null and revenue is not null")
    keyed = dm.lookup(dm.lookup(rows, "filed", times, "date", "time_id"), "ticker", entities, "name", "entity_id")
    facts = keyed.select(
        "time_id", "entity_id", F.lit("revenue").alias("metric_name"), F.col("revenue").alias("metric_value"), F.lit("USD").alias("metric_unit"), F.concat(F.lit("SEC-"), "form").alias("provenance")
    )
    path = shared_folder(spark, "filing-facts")
    for _ in range(2):
        dm.append_facts(facts, path, ["time_id", "entity_id", "metric_name"])
    return spark.read.parquet(path)


def recent_papers(spark: SparkSession, sf: str) -> DataFrame:
    return tx.recent(ad.papers(spark, sf), "published", AS_OF).select("doc_id", "search_term", "published", "url")


def last_month(spark: SparkSession, sf: str) -> DataFrame:
    """Per part the last value of its map of months to quantities, summed by month before they are gathered."""
    months = table(spark, sf, "lineitem").groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").cast("long").alias("n"))
    maps = months.groupBy("l_partkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias("by_month"))
    return maps.select(F.col("l_partkey").alias("model_id"), F.size("by_month").cast("long").alias("n_months"), tx.last_of_map(F.col("by_month")).alias("downloads_last_month"))


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {"hype_load": hype_load, "filing_load": filing_load, "recent_papers": recent_papers, "last_month": last_month}.items()}

_count = lambda text, terms: "(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms) + ")"
_DOC_DAY = "DATE '2024-01-01' + CAST(doc_id % 90 AS INT)"
_POST_DAY = "CAST(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS DATE)"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

define("filing_tok", "SELECT doc_id AS k, unnest(string_split_regex(lower(coalesce(t, '')), '[^a-z]+')) AS term FROM filing")
define("filing_sum", "SELECT k, sum(coalesce(valence, 0))::DOUBLE AS s FROM filing_tok LEFT JOIN lex USING (term) WHERE term <> '' GROUP BY k")
define("filing_hits", f"SELECT doc_id, list_transform(list_filter(string_split_regex(t, '[.!?]+'), lambda s: {_count('s', TERMS)} > 0), lambda s: trim(s, {_TRIM})) AS ss FROM filing")
define("text_sig", f"""
SELECT {_POST_DAY} AS date, role AS name, 1 AS source_id, 'sentiment' AS signal_type, 'reddit_ai_sentiment' AS metric_name, compound * {_count('whole', TERMS)} AS v, whole AS raw_text, 'post/' || k AS url FROM post JOIN postsent USING (k)
UNION ALL SELECT published, company, 2, 'sentiment', 'news_ai_sentiment', compound * (1 + ai * 0.1), title || ' ' || description, 'doc/' || doc_id
  FROM (SELECT *, {_count("title || ' ' || description", TERMS)} AS ai FROM article JOIN newsent ON doc_id = k WHERE title <> '' OR description <> '') WHERE ai > 0
UNION ALL SELECT {_DOC_DAY}, p.lang, 5, 'innovation', 'arxiv_innovation_score', innovation_score * 0.6 + research_impact_score * 0.4, text, 'paper/' || doc_id FROM paper2 p JOIN documents USING (doc_id)
UNION ALL SELECT {_DOC_DAY}, source, 7, 'sentiment', 'sec_filing_sentiment', coalesce(s / sqrt(s * s + 15), 0.0), array_to_string(ss, chr(10)), 'filing/' || doc_id
  FROM filing_hits JOIN documents USING (doc_id) LEFT JOIN filing_sum ON k = doc_id WHERE len(ss) > 0""")
define("text_days", f"SELECT row_number() OVER (ORDER BY date) AS time_id, date FROM (SELECT {_DOC_DAY} AS date FROM documents UNION SELECT {_POST_DAY} FROM conversations) WHERE date IS NOT NULL")
define("text_names", "SELECT row_number() OVER (ORDER BY name) AS entity_id, name FROM (SELECT source AS name FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations) WHERE name IS NOT NULL")

ORACLE_SQL = {
    "hype_load": oracle(f"SELECT time_id, entity_id, CAST(source_id AS INT) AS source_id, signal_type, metric_name, {r_as({'metric_value': 'v'})}, raw_text, url FROM text_sig JOIN text_days USING (date) JOIN text_names USING (name) WHERE v IS NOT NULL"),
    "filing_load": oracle(f"""
SELECT time_id, entity_id, 'revenue' AS metric_name, {r_as({'metric_value': 'CASE WHEN doc_id % 2 = 0 THEN n_chars * 1e6 ELSE 1234.0 END'})}, 'USD' AS metric_unit, CASE WHEN doc_id % 2 = 0 THEN 'SEC-10-K' ELSE 'SEC-10-Q' END AS provenance
FROM (SELECT *, {_DOC_DAY} AS date FROM documents) JOIN text_days USING (date) JOIN text_names ON name = source WHERE text IS NOT NULL"""),
    "recent_papers": f"SELECT doc_id, lang AS search_term, {_DOC_DAY} AS published, 'paper/' || doc_id AS url FROM documents WHERE {_DOC_DAY} >= DATE '{AS_OF}' - 30",
    "last_month": """
SELECT l_partkey AS model_id, count(*) AS n_months, arg_max(n, month) AS downloads_last_month FROM (
  SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey""",
}
