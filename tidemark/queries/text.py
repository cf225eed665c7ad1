"""Text and record features over documents, conversations and sales, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.expr import SHIFT, rounded
from ..operators import series as sr
from ..session import table
from ..sources import adapters as ad
from .sqlkit import define, oracle, r, r_as

# Terms that occur in the given texts; the lists of ``functions.text`` are the defaults.
TERMS = ["the", "ai", "data", "ing", "tion", "eau"]
GROUPS = {
    "novel_method": ["the", "eau"], "performance_improvement": ["ing"], "resource_efficiency": ["tion"], "reproducibility": ["data", "ung"], "practical_application": ["ció"],
    "federated_learning": ["ment"], "multimodal": ["heit"], "edge_ai": ["mobile AI"],
}
IMPACT = {"conference_quality": ["ly"], "practical_relevance": ["keit", "que"], "novel_architecture": ["zu"]}
LEXICON = {"the": 1, "and": -1, "of": 2, "to": -2, "in": 1, "is": 3, "that": -1, "it": 1, "on": -2, "for": 2, "la": 1, "de": -1, "le": 2, "les": -2, "que": 1, "der": -1, "die": 1, "das": 2, "und": -2, "el": 1}


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "term string, valence int")


def _sentiment(spark: SparkSession, df: DataFrame, key: str, text: str) -> DataFrame:
    return tx.lexicon_sentiment(df, key, text, lexicon(spark))


def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return _sentiment(spark, table(spark, sf, "documents"), "doc_id", "text")


def news_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.news(spark, sf)
    told = _sentiment(spark, rows.select("doc_id", F.concat_ws(" ", "title", "description").alias("text")), "doc_id", "text").withColumnRenamed("compound", "sentiment")
    found = tx.news_features(rows.join(told, "doc_id"), TERMS)
    return found.select(
        "doc_id", "company", "published", "ai_mentions", "title_length", "description_length", "sentiment", "sentiment_confidence", "ai_weighted_sentiment", "impact_score", "sentiment_intensity", "impact_weighted_sentiment"
    )


def post_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.posts(spark, sf).withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    told = _sentiment(spark, rows.select("key", "selftext"), "key", "selftext").withColumnRenamed("compound", "sentiment")
    found = tx.post_features(rows.join(told, "key"), TERMS)
    return found.select("conv_id", "turn", "subreddit", "score", "ai_mentions", "engagement_score", "engagement_rate", "sentiment_intensity", "ai_sentiment_score")


def paper_features(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.paper_features(ad.papers(spark, sf), GROUPS, TERMS, IMPACT)
    flags = [f"has_{k}" for k in GROUPS] + [f"is_{k}" for k in IMPACT]
    return found.select("doc_id", "search_term", *flags, "innovation_score", "technical_complexity", "research_impact_score", "innovation_intensity", "impact_score", "publication_impact")


def ai_sentences(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.ai_sentences(ad.filings(spark, sf), "filing_text", TERMS)
    return found.select("doc_id", F.size("ai_mentions").cast("long").alias("n_sentences"), F.sha2(F.array_join("ai_mentions", "|"), 256).alias("sentences_sha256"))


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """Factor texts of three kinds from the events' values: an object, loose numbers, none."""
    v, i = F.col("value").cast("string"), F.col("event_id")
    obj = F.concat(F.lit("{'divergence': np.float64("), v, F.lit("), 'acceleration': -0.5, 'pattern_similarity': 0.25}"))
    loose = F.concat(F.lit("div "), v, F.lit(" acc -1.5 pat 2"))
    return table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, obj).when(i % 3 == 1, loose).otherwise(F.concat(F.lit("nothing in "), "event_type")).alias("factors"))


def repos(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    return lines.groupBy(F.col("l_partkey").alias("repo")).agg(
        F.sum("l_quantity").cast("long").alias("stars"), F.count("*").alias("forks"), F.count_if(F.col("l_returnflag") == "R").alias("open_issues"), F.count_if(F.col("l_linestatus") == "O").alias("monthly_commits"),
        F.count_distinct("l_suppkey").alias("contributors"), F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("active"), (F.datediff(F.max(day), F.min(day)) % 40).alias("days_between_releases"),
        (F.sum("l_linenumber") - 3 * F.count("*")).cast("double").alias("momentum"), (F.count("*") - 30).cast("double").alias("activity_change"), F.min(day).alias("created"),
    )


_SCORES = ["monthly_release_frequency", "contributor_activity_ratio", "stars_per_fork", "issues_per_star", "activity_score", "community_score", "maturity_score", "trending_score"]


def repo_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tx.repo_scores(repos(spark, sf), "2001-12-31").select("repo", "community_size", "project_age_days", *_SCORES)


def trend_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    moved = sr.repo_deltas(ad.snapshots(spark, sf))
    return moved.groupBy(tx.trend_category(F.col("momentum_score"), 0.1).alias("category")).agg(F.count("*").alias("n"))


def repo_variants(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("/", "p_brand", F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))).otherwise(F.col("p_name")).alias("name"))
    return parts.select("p_partkey", F.explode(tx.repo_id_variants(F.col("name"))).alias("variant"))


def sentiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    told = lexicon_sentiment(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return told.groupBy("lang").agg(F.count("*").alias("n"), F.avg("compound").alias("mean"), F.min("compound").alias("least"), F.percentile("compound", F.lit(0.5)).alias("median"), F.max("compound").alias("most"))


def active_models(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("downloads"), F.max(F.to_date("l_shipdate")).alias("last_modified"))
    models = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("model_id"), "downloads", (F.col("p_size") % 5 == 0).alias("private"), "last_modified")
    return sr.active_models(models, "2001-10-31", 500, 90, 200)


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {
    "kw_mentions": lambda s, d: table(s, d, "documents").select("doc_id", tx.mentions(F.col("text"), TERMS).alias("mentions")),
    "kw_terms": lambda s, d: tx.term_mentions(table(s, d, "documents").select("doc_id", "text"), "text", table(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("length(term) > 3")).select("doc_id", "mentions"),
    "kw_words": lambda s, d: table(s, d, "documents").select("doc_id", tx.mentions(F.col("text"), TERMS, word_boundary=True).alias("mentions")),
    "kw_mentions_default": lambda s, d: table(s, d, "documents").select("doc_id", tx.mentions(F.col("text"), tx.NEWS_TERMS).alias("mentions")),
    "lexicon_sentiment": lexicon_sentiment,
    "news_features": news_features,
    "post_features": post_features,
    "paper_features": paper_features,
    "ai_sentences": ai_sentences,
    "filing_revenue": lambda s, d: ad.filings(s, d).select("doc_id", tx.revenue(F.col("filing_text")).alias("revenue")),
    "parse_factors": lambda s, d: factors(s, d).select("event_id", tx.parse_factors(F.col("factors")).alias("p")).select("event_id", "p.*"),
    "repo_scores": repo_scores,
    "trend_breakdown": trend_breakdown,
    "repo_variants": repo_variants,
    "sentiment_summary": sentiment_summary,
    "active_models": active_models,
}.items()}


def _count(text: str, terms: list[str], fold: bool = True) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{t.lower() if fold else t}')::INT" for t in terms) + ")"


_LEX = ", ".join(f"('{t}', {v})" for t, v in LEXICON.items())
define("lex", f"SELECT * FROM (VALUES {_LEX}) v(term, valence)")


def _sent(name: str, rows: str) -> None:
    """Defines ``name`` (k, compound, pos, neg, neu) over ``rows`` (k, t)."""
    define(f"{name}_tok", f"SELECT k, unnest(string_split_regex(lower(coalesce(t, '')), '[^a-z]+')) AS term FROM ({rows})")
    define(f"{name}_sum", f"SELECT k, sum(coalesce(valence, 0))::DOUBLE AS s, count(*)::DOUBLE AS n, count(*) FILTER (valence > 0) AS p, count(*) FILTER (valence < 0) AS g FROM {name}_tok LEFT JOIN lex USING (term) WHERE term <> '' GROUP BY k")
    define(name, f"SELECT k, coalesce(s / sqrt(s * s + 15), 0.0) AS compound, coalesce(p / n, 0.0) AS pos, coalesce(g / n, 0.0) AS neg, coalesce((n - p - g) / n, 0.0) AS neu FROM ({rows}) LEFT JOIN {name}_sum USING (k)")


_sent("docsent", "SELECT doc_id AS k, text AS t FROM documents")
define("article", "SELECT doc_id, source AS company, DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS published, trim(substr(text, 1, 80), ' ') AS title, trim(substr(text, 81), ' ') AS description, substr(text, 1, 80) || ' ' || substr(text, 81) AS raw, lang FROM documents")
_sent("newsent", "SELECT doc_id AS k, raw AS t FROM article")
define("post", "SELECT conv_id, turn, role, substr(text, 1, 60) || ' ' || text AS whole, length(text) % 100 - 1 AS score, text, conv_id || '/' || turn AS k FROM conversations")
_sent("postsent", "SELECT k, text AS t FROM post")
define("filing", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Revenue was $' || n_chars || ' million. ' || text ELSE 'Revenue of 1,234 ' || text END AS t FROM documents")
define("repo", """
SELECT l_partkey AS repo, CAST(sum(l_quantity) AS BIGINT) AS stars, count(*) AS forks, count(*) FILTER (l_returnflag = 'R') AS issues, count(*) FILTER (l_linestatus = 'O') AS commits, count(DISTINCT l_suppkey) AS people,
  count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') AS active, (max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE))) % 40 AS gap, sum(l_linenumber) - 3 * count(*) AS momentum, min(CAST(l_shipdate AS DATE)) AS created
FROM lineitem GROUP BY l_partkey""")
define("snaps", """
SELECT user_id AS name, date, sum(n) OVER w AS stars, sum(p) OVER w AS forks, n::DOUBLE AS activity_score, sum(n) OVER w * 10 AS downloads, sum(c) OVER w AS likes FROM (
  SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY ALL)
WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")
_P = "lag({c}) OVER (PARTITION BY name ORDER BY date)"
_prev = lambda c: f"coalesce({_P.format(c=c)}, 0)"
define("rdelta", f"SELECT name, date, CAST(stars - {_prev('stars')} AS BIGINT) AS stars_delta, CAST(forks - {_prev('forks')} AS BIGINT) AS forks_delta, activity_score - {_prev('activity_score')} AS activity_change FROM snaps")
define("rmom", "SELECT *, activity_change * CASE WHEN stars_delta >= 0 THEN 1 ELSE -1 END AS momentum_score FROM rdelta")
_flags = ", ".join(f"{_count('text', t, False)} > 0 AS {p}_{k}" for p, g in (("has", GROUPS), ("is", IMPACT)) for k, t in g.items())
define("paper", f"SELECT doc_id, lang, {_flags}, {_count('text', TERMS, False)} / 6 AS technical_complexity, CAST(doc_id % 7 AS INT) AS publication_impact FROM documents")
define("paper2", "SELECT *, (" + " + ".join(f"has_{k}::INT" for k in GROUPS) + ") / 8 AS innovation_score, (" + " + ".join(f"is_{k}::INT" for k in IMPACT) + ") / 3 AS research_impact_score FROM paper")
_mention = _count("title || ' ' || description", TERMS)
_pm = _count("whole", TERMS)
_num = lambda p, m: f"TRY_CAST(replace(regexp_extract(t, '{p}', 1), ',', '') AS DOUBLE) * {m}"

ORACLE_SQL = {
    "kw_mentions": f"SELECT doc_id, {_count('text', TERMS)} AS mentions FROM documents",
    "kw_terms": "WITH terms AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS t FROM benchmark) WHERE length(t) > 3) SELECT doc_id, (SELECT count(*)::INT FROM terms WHERE contains(lower(d.text), t)) AS mentions FROM documents d",
    "kw_words": "SELECT doc_id, " + " + ".join(rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{Nd}}_]){t}([^\p{{L}}\p{{Nd}}_]|$)')::INT" for t in TERMS) + " AS mentions FROM documents",
    "kw_mentions_default": f"SELECT doc_id, {_count('text', tx.NEWS_TERMS)} AS mentions FROM documents",
    "lexicon_sentiment": oracle(f"SELECT k AS doc_id, {r('compound', 'pos', 'neg', 'neu')} FROM docsent"),
    "news_features": oracle(f"""
SELECT doc_id, company, published, ai_mentions, length(title) AS title_length, length(description) AS description_length, {r_as({
    'sentiment': 'compound', 'sentiment_confidence': 'greatest(pos, neg)', 'ai_weighted_sentiment': 'compound * (1 + ai_mentions * 0.1)', 'impact_score': '1.0', 'sentiment_intensity': 'abs(compound)', 'impact_weighted_sentiment': 'compound'})}
FROM (SELECT a.*, s.*, {_mention} AS ai_mentions FROM article a JOIN newsent s ON a.doc_id = s.k WHERE title <> '' OR description <> '') WHERE ai_mentions > 0"""),
    "post_features": oracle(f"""
SELECT conv_id, turn, subreddit, score, ai_mentions, {r_as({'engagement_score': 'score + turn * 0.5', 'engagement_rate': '(score + turn * 0.5) / nullif(score + 1, 0)', 'sentiment_intensity': 'abs(compound)', 'ai_sentiment_score': 'compound * ai_mentions'})}
FROM (SELECT conv_id, turn, role AS subreddit, score, compound, {_pm} AS ai_mentions FROM post JOIN postsent USING (k))"""),
    "paper_features": oracle(f"SELECT doc_id, lang AS search_term, {', '.join([f'has_{k}' for k in GROUPS] + [f'is_{k}' for k in IMPACT])}, publication_impact, " + r_as({
        "innovation_score": "innovation_score", "technical_complexity": "technical_complexity", "research_impact_score": "research_impact_score", "innovation_intensity": "innovation_score * technical_complexity",
        "impact_score": "innovation_score * 0.6 + research_impact_score * 0.4"}) + " FROM paper2"),
    "ai_sentences": oracle(f"""
SELECT doc_id, len(ss) AS n_sentences, sha256(array_to_string(ss, '|')) AS sentences_sha256 FROM (
  SELECT doc_id, list_transform(list_filter(string_split_regex(t, '[.!?]+'), lambda s: {_count('s', TERMS)} > 0), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS ss FROM filing) WHERE len(ss) > 0"""),
    "filing_revenue": oracle("SELECT doc_id, round(coalesce(" + ", ".join(_num(p, m) for p, m in tx.REVENUE) + f") + {SHIFT}, 6) + 0.0 AS revenue FROM filing"),
    "parse_factors": f"""
SELECT event_id, {r_as({'divergence': 'CASE WHEN event_id % 3 < 2 THEN value END', 'acceleration': 'CASE event_id % 3 WHEN 0 THEN -0.5 WHEN 1 THEN -1.5 END', 'pattern': 'CASE event_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 2.0 END'})},
  CASE WHEN event_id % 3 = 2 THEN 'nothing in ' || event_type END AS rest FROM events""",
    "repo_scores": oracle(f"""
SELECT repo, stars + forks AS community_size, CAST(DATE '2001-12-31' - created AS INT) AS project_age_days, {r_as({
    'monthly_release_frequency': 'freq', 'contributor_activity_ratio': 'active / people', 'stars_per_fork': 'stars / forks', 'issues_per_star': 'issues / nullif(stars, 0)', 'activity_score': '(commits / 100 + freq / 2) / 2',
    'community_score': '(active / 50 + stars / 10000) / 2', 'maturity_score': 'least(stars / 10000, 1)', 'trending_score': 'abs(momentum) + abs(forks - 30) * 0.5'})}
FROM (SELECT *, CASE WHEN gap > 0 THEN 30 / gap ELSE 0 END AS freq FROM repo)"""),
    "trend_breakdown": oracle("SELECT CASE WHEN momentum_score > 0.1 THEN 'hot' WHEN momentum_score < -0.1 THEN 'declining' ELSE 'stable' END AS category, count(*) AS n FROM rmom GROUP BY ALL"),
    "repo_variants": """
SELECT p_partkey, unnest(list_distinct(list_filter([name, CASE WHEN len(ps) >= 2 THEN array_to_string(ps[1:2], '/') END, CASE WHEN len(ps) > 2 THEN array_to_string(ps[-2:], '/') END], lambda x: x IS NOT NULL))) AS variant
FROM (SELECT p_partkey, name, string_split(name, '/') AS ps FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || replace(p_name, ' ', '/') ELSE p_name END AS name FROM part))""",
    "sentiment_summary": oracle(f"SELECT lang, count(*) AS n, {r_as({'mean': 'avg(compound)', 'least': 'min(compound)', 'median': 'quantile_cont(compound, 0.5)', 'most': 'max(compound)'})} FROM docsent JOIN documents ON k = doc_id GROUP BY lang"),
    "active_models": """
SELECT p_partkey AS model_id, downloads, false AS private, last_modified FROM (
  SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS downloads, max(CAST(l_shipdate AS DATE)) AS last_modified FROM lineitem GROUP BY l_partkey) JOIN part ON l_partkey = p_partkey
WHERE downloads > 500 AND p_size % 5 <> 0 AND last_modified >= DATE '2001-10-31' - 90 ORDER BY downloads DESC, model_id LIMIT 200""",
}
