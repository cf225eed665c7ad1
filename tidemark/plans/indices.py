"""Weighted daily indices, the daily bubble table and the bubble table per entity.

Entity weights and maxima are windows over the entity, so one exchange by entity serves weights and normalisation, and
one by date both indices. Windows over all days run on one row per day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import min_max_score, safe_div, zero, zero_ratio
from .features import in_chunks, keys_of

def _entity():
    return Window.partitionBy("entity_id", "entity_name", "entity_type")

def _kind(value: str) -> Column:
    return F.col("entity_type") == value


def weight_parts() -> dict[str, Column]:
    """What the entity weights average, by name."""
    return {
        "intensity": zero("multi_source_hype_intensity"), "trending": zero("trending_intensity"), "github": zero("github_trending_score"), "hf": zero("hf_trending_score"),
        "innovation": zero("arxiv_innovation_score"), "innovation_100": zero("arxiv_innovation_score") * 100, "price": zero("stock_price"), "stars": F.abs("github_stars_delta"),
        "forks": F.abs("github_forks_delta"), "downloads": F.abs("hf_downloads_delta"), "moved": F.col("hf_downloads_delta"),
    }


def means(over: bool = False) -> Callable[[str], Column]:
    """Averages of :func:`weight_parts` by name; windows over the entity if ``over``, else aggregates."""
    parts = weight_parts()
    return lambda n: F.avg(parts[n]).over(_entity()) if over else F.avg(parts[n])


def hype_weight(m: Callable[[str], Column]) -> Column:
    """Weight of an entity in the hype index, from averages by name."""
    return (
        F.when(_kind("company"), (m("intensity") + m("trending")) * 2)
        .when(_kind("software"), (m("github") + m("hf")) * 1.5)
        .when(_kind("ai_model"), (m("hf") + m("innovation_100")) * 1.3)
        .otherwise(m("innovation") + m("intensity"))
    )


def reality_weight(m: Callable[[str], Column]) -> Column:
    return (
        F.when(_kind("company"), (m("price") + m("stars") * 100 + m("downloads") * 50) * 2)
        .when(_kind("software"), m("stars") * 100 + m("forks") * 50)
        .when(_kind("ai_model"), m("moved") * 50 + m("downloads") * 100)
        .otherwise(m("stars") * 100 + m("downloads") * 50)
    )


def entity_weights(combined: DataFrame, which: str) -> DataFrame:
    weight = {"hype": hype_weight, "reality": reality_weight}[which](means())
    return combined.groupBy("entity_id", "entity_name", "entity_type").agg(weight.alias("entity_weight"))


#: Normalised column to (column, whether the maximum is of absolute values).
HYPE_NORMS = {
    "norm_hype_intensity": ("multi_source_hype_intensity", False), "norm_reddit_momentum": ("reddit_sentiment_momentum", True), "norm_news_momentum": ("news_sentiment_momentum", True),
    "norm_github_trending": ("github_trending_momentum", True), "norm_trending_intensity": ("trending_intensity", False), "norm_innovation": ("arxiv_innovation_score", False),
}
REALITY_NORMS = {
    "norm_reality_strength": ("reality_strength_score", False), "norm_price_growth": ("price_30d_growth", True), "norm_github_delta": ("github_delta_30d_growth", True),
    "norm_hf_downloads": ("hf_downloads_30d_growth", True), "norm_github_cumulative": ("github_stars_cumulative_delta", True), "norm_hf_cumulative": ("hf_downloads_cumulative_delta", True),
}


def normalised(combined: DataFrame, norms: dict[str, tuple[str, bool]], since: str | None = None) -> DataFrame:
    """``combined`` with each column over its maximum per entity; if ``since``, of the rows after that date only."""
    e = Window.partitionBy("entity_id")
    inside = F.lit(True) if since is None else F.col("date") > F.lit(since).cast("date")

    def over(c: str, size: bool) -> Column:
        value = F.abs(c) if size else F.col(c)
        return zero(safe_div(c, F.max(F.when(inside, value)).over(e)))

    return combined.select("*", *[over(c, size).alias(n) for n, (c, size) in norms.items()])


def _per_day(name: str, value: Column, weight: str) -> Column:
    return (F.sum(F.col(weight) * value) / F.nullif(F.sum(weight), F.lit(0.0))).alias(name)


def _hype_aggs() -> list[Column]:
    n = lambda c: F.col(f"norm_{c}")
    sentiment = n("reddit_momentum") + n("news_momentum")
    main = n("hype_intensity") * 0.25 + sentiment * 0.2 + n("github_trending") * 0.15 + n("trending_intensity") * 0.15 + n("innovation") * 0.25
    w = "hype_weight"
    return [
        _per_day("hype_index", main, w), _per_day("hype_intensity_component", n("hype_intensity"), w), _per_day("sentiment_momentum_component", sentiment / 2, w),
        _per_day("github_trending_component", n("github_trending"), w), _per_day("trending_component", n("trending_intensity"), w), _per_day("innovation_component", n("innovation"), w),
        F.count_distinct("entity_id").alias("entity_count"), F.sum(zero("multi_source_hype_intensity") + zero("trending_intensity")).alias("total_mentions_proxy"),
    ]


def _reality_aggs() -> list[Column]:
    n = lambda c: F.col(f"norm_{c}")
    main = n("reality_strength") * 0.3 + n("price_growth") * 0.2 + n("github_delta") * 0.25 + n("hf_downloads") * 0.25
    w = "reality_weight"
    return [
        _per_day("reality_index", main, w), _per_day("reality_strength_component", n("reality_strength"), w), _per_day("price_growth_component", n("price_growth"), w),
        _per_day("github_delta_component", n("github_delta"), w), _per_day("hf_downloads_component", n("hf_downloads"), w),
        _per_day("cumulative_impact_component", (n("github_cumulative") + n("hf_cumulative")) / 2, w), F.count_distinct("entity_id").alias("entity_count"),
        F.avg(F.when(_kind("company"), F.col("price_30d_growth"))).alias("avg_company_growth"), F.avg(F.abs("github_delta_30d_growth")).alias("avg_github_momentum"),
        F.avg(F.abs("hf_downloads_30d_growth")).alias("avg_hf_momentum"),
    ]


def _after(df: DataFrame, since: str | None) -> DataFrame:
    return df if since is None else df.where(F.col("date") > F.lit(since).cast("date"))


def hype_index(combined: DataFrame, since: str | None = None, exact: bool = True) -> DataFrame:
    """The hype index per day. With ``since`` the days after it: normalised over all rows if ``exact``, else over those days."""
    rows = normalised(combined.withColumn("hype_weight", hype_weight(means(True))), HYPE_NORMS, None if exact else since)
    return _after(rows, since).groupBy("time_id", "date").agg(*_hype_aggs())


def reality_index(combined: DataFrame, since: str | None = None, exact: bool = True) -> DataFrame:
    rows = normalised(combined.withColumn("reality_weight", reality_weight(means(True))), REALITY_NORMS, None if exact else since)
    return _after(rows, since).groupBy("time_id", "date").agg(*_reality_aggs())


def both_indices(combined: DataFrame) -> DataFrame:
    """Both indices per day in one pass over ``combined``."""
    rows = combined.withColumns({"hype_weight": hype_weight(means(True)), "reality_weight": reality_weight(means(True))})
    return daily_indices(rows)


def daily_indices(weighted: DataFrame) -> DataFrame:
    """Both indices per day of rows with ``hype_weight`` and ``reality_weight``, normalised among these rows."""
    rows = normalised(weighted, HYPE_NORMS | REALITY_NORMS)
    return rows.groupBy("time_id", "date").agg(*_hype_aggs(), *[a for a in _reality_aggs()[:6]])


def latest_per_date(df: DataFrame) -> DataFrame:
    """One row per date: that with the largest time_id."""
    return df.groupBy("date").agg(F.max_by(F.struct(*[c for c in df.columns if c != "date"]), "time_id").alias("r")).select("date", "r.*")


_BUBBLE = [
    "date", "time_id", "hype_index", "reality_index", "hype_7d_avg", "reality_7d_avg", "hype_30d_avg", "reality_30d_avg", "hype_reality_gap", "hype_reality_ratio", "bubble_momentum",
    "sentiment_bubble_momentum", "github_trending_bubble_momentum", "trending_reality_divergence", "hype_score", "reality_score", "bubble_risk_score",
]


def _bubble_columns(rows: DataFrame) -> DataFrame:
    """The derived columns, from both indices, their averages (7 and 30) and components, and the ranges of both."""
    momentum = (F.col("hype_7d_avg") - F.col("reality_7d_avg")) - (F.col("hype_30d_avg") - F.col("reality_30d_avg"))
    gap, divergence = F.col("hype_index") - F.col("reality_index"), F.col("trending_component") - F.col("cumulative_impact_component")
    return rows.withColumns({
        "hype_reality_gap": gap, "hype_reality_ratio": zero_ratio("hype_index", "reality_index"), "bubble_momentum": momentum,
        "sentiment_bubble_momentum": F.col("sentiment_7") - F.col("strength_7"), "github_trending_bubble_momentum": F.col("github_7") - F.col("delta_7"),
        "trending_reality_divergence": divergence, "hype_score": min_max_score("hype_index", "hype_low", "hype_high"),
        "reality_score": min_max_score("reality_index", "reality_low", "reality_high"),
        "bubble_risk_score": (F.abs(gap) * 0.4 + F.abs(momentum) * 0.3 + F.abs(divergence) * 0.3) * 100,
    }).select(*_BUBBLE)


_SMOOTHED = {"sentiment_7": "sentiment_momentum_component", "github_7": "github_trending_component", "strength_7": "reality_strength_component", "delta_7": "github_delta_component"}


def bubble_metrics(both: DataFrame) -> DataFrame:
    """One row per date from both indices (see :func:`both_indices`); averages count rows."""
    days = latest_per_date(both)
    w = Window.orderBy("date")
    avg = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    all_days = Window.partitionBy()
    rows = days.withColumns(
        {f"{k}_{n}d_avg": avg(f"{k}_index", n) for k in ("hype", "reality") for n in (7, 30)}
        | {k: avg(c, 7) for k, c in _SMOOTHED.items()}
        | {f"{k}_{e}": f(f"{k}_index").over(all_days) for k in ("hype", "reality") for e, f in (("low", F.min), ("high", F.max))}
    )
    return _bubble_columns(rows)


def incremental_bubble(old: DataFrame, both_new: DataFrame) -> DataFrame:
    """Rows for new dates: averages by calendar days over old and new, components over new rows, ranges of old rows."""
    new = latest_per_date(both_new)
    history = old.select("date", "hype_index", "reality_index", F.lit(False).alias("is_new")).unionByName(new.select("date", "hype_index", "reality_index", F.lit(True).alias("is_new")))
    day = F.unix_date("date")
    avg = lambda c, n: F.avg(c).over(Window.orderBy(day).rangeBetween(1 - n, 0))
    smooth = history.withColumns({f"{k}_{n}d_avg": avg(f"{k}_index", n) for k in ("hype", "reality") for n in (7, 30)}).where("is_new").drop("hype_index", "reality_index", "is_new")
    rows = new.withColumns({k: avg(c, 7) for k, c in _SMOOTHED.items()}).join(smooth, "date")
    ends = old.agg(*[f(f"{k}_index").alias(f"{k}_{e}") for k in ("hype", "reality") for e, f in (("low", F.min), ("high", F.max))])
    return _bubble_columns(rows.crossJoin(F.broadcast(ends)))  # one row


def entity_bubble(combined: DataFrame, size: int | None = None) -> DataFrame:
    """The bubble table per entity; with a ``size`` by chunks of so many rows, and each entity's range by an aggregation."""
    pairs = {"hype": "multi_source_hype_intensity", "reality": "reality_strength_score"}
    ends = {f"{k}_{e}": f(c) for k, c in pairs.items() for e, f in (("low", F.min), ("high", F.max))}
    if size is None:
        ranged = combined.withColumns({n: v.over(Window.partitionBy("entity_id")) for n, v in ends.items()})
    else:
        ranges = combined.groupBy(F.col("entity_id").alias("of_entity")).agg(*[v.alias(n) for n, v in ends.items()])
        ranged = combined.join(ranges, F.col("entity_id") == F.col("of_entity")).drop("of_entity")
    return in_chunks(ranged, size, lambda rows, w: _entity_bubble(rows, w, pairs))


def _entity_bubble(ranged: DataFrame, e: Window, pairs: dict[str, str]) -> DataFrame:
    rows = ranged.withColumns({f"{k}_{n}d_avg": F.avg(c).over(e.rowsBetween(1 - n, 0)) for k, c in pairs.items() for n in (7, 30)})
    score = lambda k: min_max_score(pairs[k], f"{k}_low", f"{k}_high")
    moved = lambda c: F.col(c) - F.lag(c, 7).over(e)
    return rows.select(
        *keys_of(rows), *pairs.values(), *[f"{k}_{n}d_avg" for n in (7, 30) for k in pairs], "hype_reality_gap",
        zero_ratio(*pairs.values()).alias("hype_reality_ratio"),
        ((F.col("hype_7d_avg") - F.col("reality_7d_avg")) - (F.col("hype_30d_avg") - F.col("reality_30d_avg"))).alias("bubble_momentum"),
        "reddit_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score", "github_stars_delta", "hf_downloads_delta",
        moved("github_trending_score").alias("github_trending_momentum"), moved("hf_trending_score").alias("hf_trending_momentum"),
        score("hype").alias("hype_score"), score("reality").alias("reality_score"),
    )
