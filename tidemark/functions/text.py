"""Text features of documents: term mentions, lexicon sentiment, news, posts, papers, filings, factors, repositories.

Terms are tested as case-folded substrings, so ``ai`` also counts in ``said``; ``word_boundary`` asks for whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The term lists of the signals.
NEWS_TERMS = ["artificial intelligence", "machine learning", "deep learning", "neural network", "AI", "ML", "generative AI", "LLM", "large language model", "transformer", "GPU", "semiconductor", "chip", "data center", "cloud computing", "automation", "computer vision", "natural language processing", "robotics"]
POST_TERMS = ["AI", "artificial intelligence", "machine learning", "neural", "GPU", "LLM", "GPT"]
TECH_SOURCES = ["tech", "reuters", "bloomberg", "cnbc"]
INNOVATION_TERMS = {
    "novel_method": ["novel", "new approach", "new method", "innovative", "first time", "state-of-the-art", "sota", "breakthrough", "unprecedented"],
    "performance_improvement": ["outperform", "better than", "improvement", "superior", "higher accuracy", "faster", "more efficient", "enhanced"],
    "resource_efficiency": ["efficient", "reduced memory", "lower latency", "fewer parameters", "compressed", "lightweight", "optimization", "sparse"],
    "reproducibility": ["code available", "github", "implementation", "open source", "reproduce", "benchmark", "dataset", "replication"],
    "practical_application": ["real-world", "production", "deployed", "industry", "practical", "application", "use case", "commercial", "scalable"],
    "federated_learning": ["federated learning", "distributed learning", "privacy-preserving"],
    "multimodal": ["multimodal", "vision-language", "cross-modal", "audio-visual"],
    "edge_ai": ["edge computing", "on-device", "mobile AI", "edge deployment"],
}
TECHNICAL_TERMS = ["algorithm", "architecture", "model", "neural", "training", "optimization", "parameter", "computation", "inference", "gpu", "processor", "memory", "latency", "throughput", "benchmark", "transformer", "attention", "convolution", "backpropagation"]
IMPACT_TERMS = {
    "conference_quality": ["neurips", "icml", "iclr", "aaai", "ijcai", "cvpr", "iccv", "eccv"],
    "practical_relevance": ["production", "real-world", "deployment", "industry", "commercial"],
    "novel_architecture": ["new architecture", "novel design", "new framework", "innovative structure"],
}


def has_term(text: Column, term: str, word_boundary: bool = False, fold: bool = True) -> Column:
    """Whether the lower-cased text holds the term; ``fold`` lowers the term too."""
    needle = term.lower() if fold else term
    if word_boundary:
        return F.lower(text).rlike(rf"\b{re.escape(needle)}\b")
    return F.contains(F.lower(text), F.lit(needle))


def mentions(text: Column, terms: list[str], word_boundary: bool = False, fold: bool = True) -> Column:
    """How many of the listed terms occur; each counts once."""
    out = F.lit(0)
    for t in terms:
        out = out + F.coalesce(has_term(text, t, word_boundary, fold), F.lit(False)).cast("int")
    return out


#: Characters of terms that one automaton holds.
PACK = 4_000_000


def _finder(terms: list[str]):
    """A function of texts: how many of ``terms`` each holds."""

    @F.pandas_udf("int")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(term, i)
        automaton.make_automaton()
        for some in texts:
            yield some.map(lambda t: len({i for _, i in automaton.iter(t)}) if terms and t else 0).astype("int32")

    return found


def term_mentions(df: DataFrame, text: str, terms: DataFrame, name: str = "mentions", pack: int = PACK) -> DataFrame:
    """``df`` with how many of ``terms`` (term) occur in ``text``, as :func:`mentions` of a list, for lists of any length.

    A task finds all terms of a pack in one pass over a text, by an automaton, so the cost does not grow with their number.
    Terms beyond ``pack`` characters go in several packs, each with a pass of its own; blank and repeated terms count once
    at most, as in a list of distinct terms, and the empty term not at all.
    """
    known = terms.select(F.lower("term").alias("term")).where("term is not null and term <> ''").distinct()
    packs = max(1, -(-(known.agg(F.sum(F.length("term"))).first()[0] or 0) // pack))  # one value
    out, counts = df, []
    for k in range(packs):
        of_pack = [r["term"] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(packs)) == k).collect()]  # about ``pack`` characters
        counts.append(f"{name}_{k}")
        out = out.withColumn(counts[-1], _finder(of_pack)(F.lower(F.col(text))))
    total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return out.withColumn(name, total).drop(*counts)


def any_term(text: Column, terms: list[str], fold: bool = True) -> Column:
    return mentions(text, terms, fold=fold) > 0


def lexicon_sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, compound, pos, neg, neu) from valences of tokens: s / sqrt(s^2 + 15), and shares of tokens by sign.

    ``lexicon``: (term, valence), joined by its size as Spark sees fit. Texts without tokens have compound 0.
    """
    tokens = df.select(F.col(key), F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+")).alias("term"))
    per = tokens.where("term <> ''").groupBy(key, "term").agg(F.count("*").alias("n")).join(lexicon, "term", "left")
    total = F.sum("n")
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / total
    v = F.coalesce("valence", F.lit(0))
    scored = per.groupBy(key).agg(F.sum(v * F.col("n")).cast("double").alias("s"), share(v > 0).alias("pos"), share(v < 0).alias("neg"), share(v == 0).alias("neu"))
    told = scored.select(key, (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("compound"), "pos", "neg", "neu")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return df.select(key).join(told, key, "left").select(key, *[zero(c) for c in ("compound", "pos", "neg", "neu")])


def _tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+")


def compound_of(text: Column, valences: dict[str, int]) -> Column:
    """The compound of :func:`lexicon_sentiment`, never null, for a lexicon that fits an expression: texts stay where they are."""
    value = F.create_map(*[F.lit(x) for term, v in valences.items() for x in (term, F.lit(v).cast("long"))])
    met = F.filter(_tokens(text), lambda t: t.isin([k for k, v in valences.items() if v]))
    s = F.aggregate(met, F.lit(0).cast("long"), lambda total, t: total + F.element_at(value, t)).cast("double")
    return F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0))


def share_of(text: Column, terms: list[str]) -> Column:
    """The share of a text's tokens that are ``terms``: pos of :func:`lexicon_sentiment` for those of a positive valence; never null."""
    tokens = F.filter(_tokens(text), lambda t: t != "")
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: t.isin(terms))), F.size(tokens)), F.lit(0.0))


def news_features(articles: DataFrame, terms: list[str] = NEWS_TERMS) -> DataFrame:
    """Articles (title, description, source, sentiment, pos, neg) with content and a mention, and their features."""
    clean = articles.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "description")}).where("title <> '' or description <> ''")
    counted = clean.withColumn("ai_mentions", mentions(F.concat_ws(" ", "title", "description"), terms)).where("ai_mentions > 0")
    impact = F.when(any_term(F.coalesce("source", F.lit("")), TECH_SOURCES), 1.5).otherwise(1.0)
    weighted = F.col("sentiment") * (1 + F.col("ai_mentions") * 0.1)
    return counted.withColumns({
        "sentiment_confidence": F.greatest("pos", "neg"), "ai_weighted_sentiment": weighted, "ai_sentiment_score": weighted, "impact_score": impact, "title_length": F.length("title"),
        "description_length": F.length("description"), "sentiment_intensity": F.abs("sentiment"), "impact_weighted_sentiment": F.col("sentiment") * impact,
    })


def post_features(posts: DataFrame, terms: list[str] = POST_TERMS, since: str = "2020-01-01") -> DataFrame:
    """Posts (created_utc, title, selftext, score, num_comments, sentiment) since a date; the rate is null at a score of -1."""
    recent = posts.where(F.timestamp_seconds("created_utc") >= F.lit(since).cast("timestamp"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    engagement = F.col("score") + F.col("num_comments") * 0.5
    counted = recent.withColumns({"ai_mentions": mentions(text, terms), "engagement_score": engagement})
    return counted.withColumns({
        "engagement_rate": F.try_divide(F.col("engagement_score"), (F.col("score") + 1).cast("double")), "sentiment_intensity": F.abs("sentiment"), "ai_sentiment_score": F.col("sentiment") * F.col("ai_mentions"),
    })


def paper_features(papers: DataFrame, innovation: dict[str, list[str]] = INNOVATION_TERMS, technical: list[str] = TECHNICAL_TERMS, impact: dict[str, list[str]] = IMPACT_TERMS) -> DataFrame:
    """Papers (abstract, n_authors) with flags and scores. Terms are tested as written against the lower-cased abstract."""
    text = F.coalesce("abstract", F.lit(""))
    flags = {f"has_{k}": any_term(text, t, fold=False) for k, t in innovation.items()} | {f"is_{k}": any_term(text, t, fold=False) for k, t in impact.items()}
    rows = papers.withColumns(flags)
    mean = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0)) / len(names)
    rows = rows.withColumns({
        "innovation_score": mean([f"has_{k}" for k in innovation]), "technical_complexity": mentions(text, technical, fold=False) / len(technical),
        "research_impact_score": mean([f"is_{k}" for k in impact]), "publication_impact": F.col("n_authors"),
    })
    return rows.withColumns({
        "innovation_intensity": F.col("innovation_score") * F.col("technical_complexity"), "impact_score": F.col("innovation_score") * 0.6 + F.col("research_impact_score") * 0.4,
    })


def ai_sentences(filings: DataFrame, text: str, terms: list[str] = NEWS_TERMS) -> DataFrame:
    """Filings with the array of their trimmed sentences that hold a term; those without any are dropped."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]+")
    found = F.transform(F.filter(parts, lambda s: any_term(s, terms)), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c")))
    return filings.withColumn("ai_mentions", found).where(F.size("ai_mentions") > 0)


#: The patterns for revenue, in order, with what a match is multiplied by.
REVENUE = [(r"(?i)revenue.*?\$?\s*([\d,]+\.?\d*)\s*billion", 1e9), (r"(?i)revenue.*?\$?\s*([\d,]+\.?\d*)\s*million", 1e6), (r"(?i)revenue.*?\$?\s*([\d,]+\.?\d*)", 1.0)]


def revenue(text: Column) -> Column:
    """The first revenue figure by three patterns in order; null if none can be read."""
    one = lambda p, m: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double") * m
    return F.coalesce(*[one(p, m) for p, m in REVENUE])


def repo_scores(repos: DataFrame, as_of: str) -> DataFrame:
    """Scores of repositories (stars, forks, open_issues, monthly_commits, days_between_releases, contributors, active, momentum, activity_change, created)."""
    stars = F.col("stars").cast("double")
    frequency = F.when(F.col("days_between_releases") > 0, 30 / F.nullif(F.col("days_between_releases"), F.lit(0))).otherwise(0.0)
    rows = repos.withColumn("monthly_release_frequency", frequency)
    return rows.withColumns({
        "contributor_activity_ratio": F.when(F.col("contributors") > 0, F.try_divide(F.col("active").cast("double"), F.col("contributors").cast("double"))).otherwise(0.0),
        "stars_per_fork": F.try_divide(stars, F.col("forks").cast("double")), "issues_per_star": F.try_divide(F.col("open_issues").cast("double"), stars),
        "community_size": F.col("stars") + F.col("forks"), "activity_score": (F.col("monthly_commits") / 100 + F.col("monthly_release_frequency") / 2) / 2,
        "community_score": (F.col("active") / 50 + stars / 10000) / 2, "maturity_score": F.least(stars / 10000, F.lit(1.0)),
        "trending_score": F.abs("momentum") + F.abs("activity_change") * 0.5, "project_age_days": F.datediff(F.lit(as_of).cast("date"), "created"),
    })


def trend_category(x: Column, band: float) -> Column:
    return F.when(x > band, "hot").when(x < -band, "declining").otherwise("stable")


def parse_factors(text: Column) -> Column:
    """(divergence, acceleration, pattern, rest): JSON first, then the first three numbers, else 50 characters."""
    plain = F.regexp_replace(F.regexp_replace(text, r"np\.float64\(([^)]+)\)", "$1"), "'", '"')
    parsed = F.from_json(plain, "divergence double, acceleration double, pattern_similarity double", {"mode": "PERMISSIVE"})
    is_json = F.coalesce(F.json_object_keys(plain).isNotNull(), F.lit(False))
    numbers = F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), F.lit(0))
    number = lambda i: F.when(F.size(numbers) >= 3, F.try_element_at(numbers, F.lit(i)).try_cast("double"))
    pick = lambda name, i: F.when(is_json, F.coalesce(parsed[name], F.lit(0.0))).otherwise(number(i))
    rest = F.when(~is_json & (F.size(numbers) < 3), F.substring(text, 1, 50))
    return F.struct(pick("divergence", 1).alias("divergence"), pick("acceleration", 2).alias("acceleration"), pick("pattern_similarity", 3).alias("pattern"), rest.alias("rest"))


def repo_id_variants(name: Column) -> Column:
    """Candidate ids: the name, its first two path parts, and its last two where there are more."""
    parts = F.split(name, "/")
    first = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "/"))
    last = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/"))
    return F.array_distinct(F.array_compact(F.array(name, first, last)))


def recent(rows: DataFrame, when: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` up to ``as_of``; those without a date are left out."""
    return rows.where(F.col(when) >= F.date_sub(F.lit(as_of).cast("date"), days))


def last_of_map(values: Column) -> Column:
    """The value of a map's last entry, 0 for an empty or missing map."""
    return F.coalesce(F.try_element_at(F.map_values(values), F.lit(-1)), F.lit(0))
