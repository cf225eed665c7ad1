"""Daily features per entity: hype, reality and both combined. Windows count rows, not days."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import growth, zero, zero_ratio
from ..operators import chunks as ch
from ..session import materialised

KEYS = ["time_id", "date", "entity_id", "entity_name", "entity_type"]

#: Metric name to column of the daily table, and to the column that counts its signals.
HYPE = {
    "reddit_ai_sentiment": ("reddit_sentiment", "reddit_mentions"),
    "news_ai_sentiment": ("news_sentiment", "news_mentions"),
    "github_trending_score": ("github_trending", "github_mentions"),
    "huggingface_trending_score": ("hf_trending", "hf_mentions"),
    "arxiv_innovation_score": ("arxiv_innovation", "research_mentions"),
}
REALITY = {
    "stock_price": "stock_price", "trading_volume": "trading_volume", "github_stars_delta": "github_stars_delta", "github_forks_delta": "github_forks_delta",
    "model_downloads_delta": "hf_downloads_delta",
}


def _of(metric: str) -> Column:
    return F.when(F.col("metric_name") == metric, F.col("metric_value"))


def _named(daily: DataFrame, times: DataFrame, entities: DataFrame) -> DataFrame:
    return daily.join(times.select("time_id", "date"), "time_id").join(entities.select("entity_id", F.col("name").alias("entity_name"), "entity_type"), "entity_id")


def hype_aggs() -> list[Column]:
    return [F.avg(_of(m)).alias(c) for m, (c, _) in HYPE.items()] + [F.count(F.when(F.col("metric_name") == m, 1)).alias(n) for m, (_, n) in HYPE.items()]


def reality_aggs() -> list[Column]:
    return [F.avg(_of(m)).alias(c) for m, c in REALITY.items()]


def daily_hype(facts: DataFrame, times: DataFrame, entities: DataFrame) -> DataFrame:
    """Averages and counts per entity and day; aggregated before the dimensions are joined."""
    daily = facts.groupBy("entity_id", "time_id").agg(*hype_aggs())
    return _named(daily, times, entities).select(*KEYS, *[c for c, _ in HYPE.values()], *[n for _, n in HYPE.values()])


def daily_reality(facts: DataFrame, times: DataFrame, entities: DataFrame) -> DataFrame:
    daily = facts.groupBy("entity_id", "time_id").agg(*reality_aggs())
    return _named(daily, times, entities).select(*KEYS, *REALITY.values())


def daily_of_signals(signals: DataFrame, aggs: list[Column], times: DataFrame, entities: DataFrame) -> DataFrame:
    """As :func:`daily_hype` or :func:`daily_reality` of the facts of these signals, without keying each signal.

    Signals (date, entity_type, name, metric_name, metric_value) are aggregated by their natural keys, within each task
    first, so the dimensions meet one row per entity and day.
    """
    daily = signals.groupBy("entity_type", "name", "date").agg(*aggs)
    known = entities.select("entity_id", F.col("name").alias("entity_name"), "entity_type")
    met = daily.withColumnRenamed("name", "entity_name").join(known, ["entity_name", "entity_type"]).join(times.select("time_id", "date"), "date")
    return met.select(*KEYS, *[c for c in daily.columns if c not in ("entity_type", "name", "date")])


def daily_of_metrics(daily: DataFrame, times: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`daily_hype` and :func:`daily_reality` of a table with both: ``<metric>`` and ``<metric>_n`` per entity and day."""
    known = entities.select("entity_id", F.col("name").alias("entity_name"), "entity_type")
    met = daily.withColumnRenamed("name", "entity_name").join(known, ["entity_name", "entity_type"]).join(times.select("time_id", "date"), "date")
    some = lambda metrics: reduce(lambda a, b: a | b, [F.col(f"{m}_n") > 0 for m in metrics])
    hype = met.where(some(HYPE)).select(*KEYS, *[F.col(m).alias(c) for m, (c, _) in HYPE.items()], *[F.col(f"{m}_n").alias(n) for m, (_, n) in HYPE.items()])
    reality = met.where(some(REALITY)).select(*KEYS, *[F.col(m).alias(c) for m, c in REALITY.items()])
    return hype, reality


def by_entity(order: str = "date") -> "Window":
    return Window.partitionBy("entity_id").orderBy(order)


def rolling(c: str, rows: int, f=F.avg, w: Window | None = None) -> Column:
    """``f`` over the last ``rows`` rows of the entity."""
    return f(c).over((w or by_entity()).rowsBetween(1 - rows, 0))


def change(c: str, rows: int, w: Window | None = None) -> Column:
    """Relative change against the value ``rows`` rows before."""
    return growth(F.col(c), F.lag(c, rows).over(w or by_entity()))


def volatility(c: str, rows: int = 30) -> Column:
    return F.stddev_samp(c).over(by_entity().rowsBetween(1 - rows, 0))


#: How many rows the windows of features reach back.
REACH = 30


def in_chunks(daily: DataFrame, size: int | None, compute) -> DataFrame:
    """``compute(daily, window)`` by entity; with a ``size`` by chunks of so many rows, so that no entity is one task."""
    return compute(daily, by_entity()) if size is None else ch.windowed(daily, ["entity_id"], ["date"], size, REACH, compute)


def keys_of(df: DataFrame) -> list[str]:
    return [*KEYS, *[c for c in (ch.ROW, ch.CHUNK, ch.OWN) if c in df.columns]]


def hype_features(daily: DataFrame, size: int | None = None) -> DataFrame:
    """Rolling averages, momentum and intensity; ``size``: see :func:`in_chunks`."""
    return in_chunks(daily, size, _hype_features)


def _hype_features(daily: DataFrame, over: Window) -> DataFrame:
    w = daily.select(
        "*",
        *[rolling(c, 7, w=over).alias(f"{c}_7") for c in ("reddit_sentiment", "news_sentiment", "github_trending", "hf_trending")],
        *[rolling(c, 30, w=over).alias(f"{c}_30") for c in ("reddit_sentiment", "news_sentiment")],
        *[change(c, 7, over).alias(f"{c}_change") for c in ("reddit_sentiment", "news_sentiment", "github_trending")],
    )
    mentions = F.col("github_mentions") + F.col("hf_mentions")
    weighted = zero("github_trending_7") * F.col("github_mentions") + zero("hf_trending_7") * F.col("hf_mentions")
    quarters = [zero(f"{c}_7") * 0.25 for c in ("reddit_sentiment", "news_sentiment", "github_trending", "hf_trending")]
    return w.select(
        *keys_of(w),
        zero("reddit_sentiment").alias("reddit_sentiment_score"), zero("news_sentiment").alias("news_sentiment_score"), zero("github_trending").alias("github_trending_score"),
        zero("hf_trending").alias("hf_trending_score"), zero("arxiv_innovation").alias("arxiv_innovation_score"),
        *[n for _, n in HYPE.values()],
        zero("reddit_sentiment_7").alias("reddit_sentiment_7d_avg"), zero("news_sentiment_7").alias("news_sentiment_7d_avg"), zero("reddit_sentiment_30").alias("reddit_sentiment_30d_avg"),
        zero("news_sentiment_30").alias("news_sentiment_30d_avg"), zero("github_trending_7").alias("github_trend_7d_avg"), zero("hf_trending_7").alias("hf_trend_7d_avg"),
        zero("reddit_sentiment_change").alias("reddit_sentiment_momentum"), zero("news_sentiment_change").alias("news_sentiment_momentum"), zero("github_trending_change").alias("github_trending_momentum"),
        (quarters[0] + quarters[1] + quarters[2] + quarters[3]).alias("multi_source_hype_intensity"),
        (weighted / F.nullif(mentions, F.lit(0))).alias("trending_intensity"),
    )


def reality_features(daily: DataFrame, size: int | None = None) -> DataFrame:
    """Rolling averages and sums, growth and strength; ``size``: see :func:`in_chunks`."""
    return in_chunks(daily, size, _reality_features)


def _reality_features(daily: DataFrame, over: Window) -> DataFrame:
    w = daily.select(
        "*",
        *[rolling(c, n, w=over).alias(name) for c, n, name in (("stock_price", 7, "price_7"), ("github_stars_delta", 7, "stars_7"), ("hf_downloads_delta", 7, "downloads_7"), ("stock_price", 30, "price_30"))],
        *[change(c, 30, over).alias(f"{c}_growth") for c in ("stock_price", "github_stars_delta", "hf_downloads_delta")],
        *[rolling(c, 30, F.sum, over).alias(f"{c}_sum") for c in ("github_stars_delta", "hf_downloads_delta")],
    )
    price, stars, downloads = zero("stock_price_growth"), zero("github_stars_delta_growth"), zero("hf_downloads_delta_growth")
    kind = F.col("entity_type")
    strength = F.when(kind == "company", price * 0.4 + stars * 0.3 + downloads * 0.3).when(kind == "software", stars).when(kind == "ai_model", downloads).otherwise(stars + downloads)
    return w.select(
        *keys_of(w),
        *[zero(c).alias(c) for c in REALITY.values()],
        zero("price_7").alias("price_7d_avg"), zero("stars_7").alias("github_stars_7d_delta"), zero("downloads_7").alias("hf_downloads_7d_delta"), zero("price_30").alias("price_30d_avg"),
        price.alias("price_30d_growth"), stars.alias("github_delta_30d_growth"), downloads.alias("hf_downloads_30d_growth"),
        zero("github_stars_delta_sum").alias("github_stars_cumulative_delta"), zero("hf_downloads_delta_sum").alias("hf_downloads_cumulative_delta"),
        strength.alias("reality_strength_score"),
    )


def combined_features(hype: DataFrame, reality: DataFrame) -> DataFrame:
    """Inner join by day and entity, with gaps and ratio."""
    h, r = hype.alias("h"), reality.alias("r")
    both = h.join(r, (F.col("h.time_id") == F.col("r.time_id")) & (F.col("h.entity_id") == F.col("r.entity_id")))
    intensity, strength = F.col("h.multi_source_hype_intensity"), F.col("r.reality_strength_score")
    return both.select(
        *[F.col(f"h.{c}") for c in (*KEYS, "reddit_sentiment_score", "news_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score")],
        *[F.col(f"h.{c}") for c in ("reddit_sentiment_momentum", "news_sentiment_momentum", "github_trending_momentum", "multi_source_hype_intensity", "trending_intensity")],
        *[F.col(f"r.{c}") for c in REALITY.values()],
        *[F.col(f"r.{c}") for c in ("price_30d_growth", "github_delta_30d_growth", "hf_downloads_30d_growth", "github_stars_cumulative_delta", "hf_downloads_cumulative_delta")],
        intensity.alias("hype_intensity_score"), strength,
        (intensity - strength).alias("hype_reality_gap"), zero_ratio(intensity, strength).alias("hype_reality_ratio"),
        (F.col("h.trending_intensity") - F.col("r.github_delta_30d_growth")).alias("trending_reality_gap"),
        (F.col("h.arxiv_innovation_score") - zero("r.hf_downloads_30d_growth")).alias("innovation_adoption_gap"),
    )


def pair_correlation(daily: DataFrame, value: str, rows: int = 30) -> DataFrame:
    """(date, entity_id, other_id, corr) of each ordered pair that has the same days; rolling, null without variance.

    Rows without a value are left out first; each unordered pair is computed once and mirrored.
    """
    own = daily.where(F.col(value).isNotNull()).select("date", "entity_id", F.col(value).alias("x"))
    other = own.select("date", F.col("entity_id").alias("other_id"), F.col("x").alias("y"))
    met = own.join(other, "date").where("entity_id < other_id")
    w = Window.partitionBy("entity_id", "other_id").orderBy("date").rowsBetween(1 - rows, 0)
    spread = F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w)
    one = met.select("date", "entity_id", "other_id", F.covar_pop("x", "y").over(w).alias("cov"), spread.alias("spread"))
    one = one.select("date", "entity_id", "other_id", F.when(F.col("spread") > 1e-12, F.col("cov") / F.col("spread")).alias("corr"))
    return one.unionByName(one.select("date", F.col("other_id").alias("entity_id"), F.col("entity_id").alias("other_id"), "corr"))


def correlation_per_entity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("date", "entity_id").agg(F.avg("corr").alias("correlation"))


def rolling_block(x: np.ndarray, y: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling correlation of every series of ``x`` with every one of ``y`` (series by day, NaN where absent), and where both are.

    Windows count the days that both have. Days of a pair are moved to the front, so one sum over lags serves all pairs.
    """
    both = ~np.isnan(x)[:, None, :] & ~np.isnan(y)[None, :, :]
    order = np.argsort(~both, axis=2, kind="stable")
    there = np.take_along_axis(both, order, 2)
    a, b = (np.where(there, np.take_along_axis(np.broadcast_to(v, both.shape), order, 2), 0.0) for v in (x[:, None, :], y[None, :, :]))
    days = both.shape[2]
    n = np.minimum(np.arange(1, days + 1), rows)
    late = lambda v, k: np.concatenate((np.zeros((*v.shape[:2], k)), v[:, :, : days - k]), axis=2) if k else v
    lags = range(min(rows, days))
    mean_a, mean_b = (sum(late(v, k) for k in lags) / n for v in (a, b))
    cov, var_a, var_b = (np.zeros(both.shape) for _ in range(3))
    for k in lags:
        inside = k < n
        da, db = np.where(inside, late(a, k) - mean_a, 0.0), np.where(inside, late(b, k) - mean_b, 0.0)
        cov, var_a, var_b = cov + da * db, var_a + da * da, var_b + db * db
    spread = np.sqrt(var_a / n) * np.sqrt(var_b / n)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where(there & (spread > 1e-12), cov / n / spread, np.nan)
    out = np.full(both.shape, np.nan)
    np.put_along_axis(out, order, corr, 2)
    return out, both


#: The most series of a block, and the most cells (pairs by days) of two blocks that one task holds.
BLOCK, CELLS = 32, 3_000_000


def entity_correlation(daily: DataFrame, value: str, rows: int = 30, block: int = BLOCK) -> DataFrame:
    """:func:`correlation_per_entity` of :func:`pair_correlation`, without a row per pair.

    Entities are dealt into blocks; a task correlates a block with another in numpy steps, and what leaves it is one sum per
    entity and day, which add up within tasks before they are shuffled.
    """
    own = daily.where(F.col(value).isNotNull()).select("date", "entity_id", F.col(value).cast("double").alias("x"))
    lines = own.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), "x"))).alias("own"))
    lines = materialised(lines.select("entity_id", F.col("own.day").alias("days"), F.col("own.x").alias("xs")))
    held, longest = lines.agg(F.count("*"), F.max(F.size("days"))).first()  # two values
    blocks = max(1, -(-held // max(1, min(block, math.isqrt(CELLS // max(1, longest or 1))))))
    at = F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).cast("int")
    placed = lines.withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = placed.select("entity_id", "days", "xs", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def correlate(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        left, right = frame[frame["block"] == low], frame[frame["block"] == high]
        days = np.unique(np.concatenate(list(frame["days"])))
        x, y = np.full((len(left), len(days)), np.nan), np.full((len(right), len(days)), np.nan)
        for side, m in ((left, x), (right, y)):
            for i, (d, v) in enumerate(zip(side["days"], side["xs"])):
                m[i, np.searchsorted(days, d)] = v
        if not len(left) or not len(right):
            return pd.DataFrame({"entity_id": [], "day": [], "total": [], "n": [], "met": []})
        corr, both = rolling_block(x, y, rows)
        if low == high:
            same = np.eye(len(left), dtype=bool)
            corr[same], both[same] = np.nan, False
        out = []
        for side, axis in ((left, 1), (right, 0)) if low != high else ((left, 1),):
            met, n = both.sum(axis), (~np.isnan(corr)).sum(axis)
            i, d = np.nonzero(met)
            out.append(pd.DataFrame({"entity_id": side["entity_id"].to_numpy()[i], "day": days[d], "total": np.nansum(corr, axis)[i, d], "n": n[i, d], "met": met[i, d]}))
        return pd.concat(out)

    sums = paired.groupBy("low", "high").applyInPandas(correlate, "entity_id long, day int, total double, n long, met long")
    per = sums.groupBy("entity_id", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return per.select(F.date_from_unix_date("day").alias("date"), "entity_id", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("correlation"))
