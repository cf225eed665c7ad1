"""Features, indices and bubble tables over the sales signals, with their oracles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..plans import features as ft
from ..plans import indices as ix
from ..plans import refresh
from ..session import materialised
from ..sources import adapters as ad
from ..streaming.jobs import shared_folder
from .sqlkit import BUBBLE, COMBINED, CUT, ENTITY, HINDEX, RINDEX, TABLES, change, define, oracle, over, r, r_as

IDS = "time_id, date, entity_id, entity_name, entity_type"


def daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily hype and reality, from one scan and one aggregation of the line items."""
    return ft.daily_of_metrics(materialised(ad.daily_signals(ad.sales(spark, sf))), *ad.star(spark, sf))


def daily_hype(spark: SparkSession, sf: str) -> DataFrame:
    return ft.daily_of_signals(ad.hype_signals(ad.sales(spark, sf)), ft.hype_aggs(), *ad.star(spark, sf))


def daily_reality(spark: SparkSession, sf: str) -> DataFrame:
    return ft.daily_of_signals(ad.reality_signals(ad.sales(spark, sf)), ft.reality_aggs(), *ad.star(spark, sf))


def star_join(spark: SparkSession, sf: str) -> DataFrame:
    """Daily hype from the fact table, keyed row by row."""
    dims = ad.star(spark, sf)
    return ft.daily_hype(ad.hype_facts(spark, sf, dims), *dims)


def combined(spark: SparkSession, sf: str) -> DataFrame:
    hype, reality = daily(spark, sf)
    return ft.combined_features(ft.hype_features(hype), ft.reality_features(reality))


def bubble(spark: SparkSession, sf: str) -> DataFrame:
    return ix.bubble_metrics(ix.both_indices(combined(spark, sf)))


def entity_bubble(spark: SparkSession, sf: str) -> DataFrame:
    return ix.entity_bubble(combined(spark, sf))


def _windows(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    daily = daily_hype(spark, sf) if kind in ("roll7", "roll30", "momentum7", "volatility30") else daily_reality(spark, sf)
    keys = ["date", "entity_id"]
    if kind in ("roll7", "roll30"):
        n = int(kind[4:])
        return daily.select(*keys, *[ft.rolling(c, n).alias(f"{c}_avg") for c in ("reddit_sentiment", "github_trending", "hf_trending")])
    if kind == "momentum7":
        return daily.select(*keys, *[ft.change(c, 7).alias(f"{c}_momentum") for c in ("reddit_sentiment", "news_sentiment", "github_trending")])
    if kind == "volatility30":
        return daily.select(*keys, *[ft.volatility(c).alias(f"{c}_volatility") for c in ("reddit_sentiment", "news_sentiment")])
    if kind == "growth30":
        return daily.select(*keys, *[ft.change(c, 30).alias(f"{c}_growth") for c in ("stock_price", "github_stars_delta", "hf_downloads_delta")])
    return daily.select(*keys, *[ft.rolling(c, 30, F.sum).alias(f"{c}_sum") for c in ("github_stars_delta", "hf_downloads_delta")])


def pair_corr(spark: SparkSession, sf: str) -> DataFrame:
    return ft.entity_correlation(daily_hype(spark, sf), "github_trending")


def norm_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return ix.normalised(combined(spark, sf), {k: ix.HYPE_NORMS[k] for k in ("norm_hype_intensity", "norm_reddit_momentum")}).select("date", "entity_id", "norm_hype_intensity", "norm_reddit_momentum")


def range_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of the daily indices over trailing calendar days, by a range window."""
    days = ix.both_indices(combined(spark, sf))
    w = Window.orderBy(F.unix_date("date"))
    return days.select("date", *[F.avg(f"{k}_index").over(w.rangeBetween(1 - n, 0)).alias(f"{k}_{n}_days") for k in ("hype", "reality") for n in (7, 30)])


def incr_bubble(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(materialised(combined(spark, sf)))


def _incremental(rows: DataFrame) -> DataFrame:
    old = ix.bubble_metrics(ix.both_indices(rows)).where(F.col("date") <= F.lit(CUT).cast("date"))
    new = ix.hype_index(rows, CUT, exact=False).drop("entity_count").join(ix.reality_index(rows, CUT, exact=False).drop("time_id", "entity_count"), "date")
    return ix.incremental_bubble(old, new)


def upsert_bubble(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.staging import upsert

    rows = materialised(combined(spark, sf))
    return upsert(ix.bubble_metrics(ix.both_indices(rows)), _incremental(rows), ["date"])


def refresh_bubble(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table after a first run up to a date, a refresh from its own latest date, and one without new days."""
    hype, reality = (materialised(d) for d in daily(spark, sf))
    store, first = shared_folder(spark, "bubble"), F.col("date") <= F.lit(CUT).cast("date")
    refresh.refresh(spark, store, hype.where(first), reality.where(first))
    for _ in range(2):
        refresh.refresh(spark, store, hype, reality)
    return refresh.stored(spark, store)


def late_bubble(spark: SparkSession, sf: str) -> DataFrame:
    """The bubble table after a load without the lines of some orders, and a refresh by these, which are late for most days."""
    sales, star = ad.sales(spark, sf), ad.star(spark, sf)
    late = F.col("l_orderkey") % 500 == 7
    hype, reality = (materialised(d) for d in ft.daily_of_metrics(ad.daily_signals(sales.where(~late)), *star))
    store = shared_folder(spark, "late")
    everything = hype.select("entity_id", "date").unionByName(reality.select("entity_id", "date"))
    refresh.late_refresh(spark, store, hype, reality, everything, 0)
    new = [d.select("entity_id", "date") for d in ft.daily_of_metrics(materialised(ad.daily_signals(sales.where(late))), *star)]
    refresh.late_refresh(spark, store, *daily(spark, sf), new[0].unionByName(new[1]), 1)
    return refresh.late_bubble(spark, store)


def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """One row per month of the daily bubble table, the latest day's."""
    rows = bubble(spark, sf).select(F.trunc("date", "month").alias("month"), "date", "time_id", "hype_index")
    return rows.groupBy("month").agg(F.max_by(F.struct("date", "time_id", "hype_index"), "date").alias("r")).select("month", "r.*")


def top_risk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.serving import top_risk as top

    return top(entity_bubble(spark, sf))


def latest_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.serving import latest_per_entity as latest

    return latest(entity_bubble(spark, sf)).select("entity_id", "date", "entity_name", "hype_score", "reality_score", "bubble_momentum")


def top_intensity(spark: SparkSession, sf: str) -> DataFrame:
    rows = combined(spark, sf).where("entity_name is not null")
    return rows.orderBy(F.desc(F.round("multi_source_hype_intensity", 6)), "date", "entity_id").limit(5).select("date", "entity_name", "entity_type", "multi_source_hype_intensity", "reality_strength_score", "hype_reality_gap")


def index_series(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.serving import index_series as series

    return series(bubble(spark, sf), "1996-01-01", "1999-12-31")


def latest_kpis(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.serving import latest_kpis as kpis

    return kpis(bubble(spark, sf))


def latest_point(spark: SparkSession, sf: str) -> DataFrame:
    return bubble(spark, sf).withColumn("computed_at", F.current_timestamp()).agg(F.max_by(F.struct("*"), F.struct("computed_at", "date")).alias("r")).select("r.*").drop("computed_at")


def date_gaps(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quality import date_gaps as gaps

    brands = daily_hype(spark, sf)
    return gaps(brands, "date", 7, "entity_id")


# the table as it was stored at the cut, from the days up to it alone, and the days that a refresh adds
define("comb_first", f"SELECT * FROM comb WHERE date <= DATE '{CUT}'")
for new, old, swaps in (
    ("wh_first", "wh", ("comb",)), ("wr_first", "wr", ("comb",)), ("nh_first", "nh", ("comb", "wh")), ("nr_first", "nr", ("comb", "wr")), ("hidx_first", "hidx", ("nh",)), ("ridx_first", "ridx", ("nr",)),
    ("days_first", "days", ("hidx", "ridx")), ("bubble_first", "bubble", ("days",)),
):
    define(new, reduce(lambda sql, name: re.sub(rf"\b{name}\b", f"{name}_first", sql), swaps, TABLES[old]))
define("history_first", TABLES["history"].replace("old_bubble", "bubble_first"))
define("refreshed", re.sub(r"\bhistory\b", "history_first", TABLES["incr"]).replace("old_bubble", "bubble_first"))


_W = lambda items: oracle(f"SELECT date, entity_id, {r_as({n: e for e, n, _ in items})} FROM {'dhype' if items[0][2] == 'h' else 'dreal'}")


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {
    "daily_hype": daily_hype,
    "daily_reality": daily_reality,
    "star_join": star_join,
    "hype_features": lambda s, d: ft.hype_features(daily_hype(s, d)),
    "reality_features": lambda s, d: ft.reality_features(daily_reality(s, d)),
    "combined_features": combined,
    "hype_weights": lambda s, d: ix.entity_weights(combined(s, d), "hype"),
    "reality_weights": lambda s, d: ix.entity_weights(combined(s, d), "reality"),
    "hype_index": lambda s, d: ix.hype_index(combined(s, d)),
    "reality_index": lambda s, d: ix.reality_index(combined(s, d)),
    "bubble_metrics": bubble,
    "entity_bubble": entity_bubble,
    "roll7": lambda s, d: _windows(s, d, "roll7"),
    "roll30": lambda s, d: _windows(s, d, "roll30"),
    "momentum7": lambda s, d: _windows(s, d, "momentum7"),
    "volatility30": lambda s, d: _windows(s, d, "volatility30"),
    "growth30": lambda s, d: _windows(s, d, "growth30"),
    "cum_delta30": lambda s, d: _windows(s, d, "cum_delta30"),
    "pair_corr": pair_corr,
    "norm_by_entity": norm_by_entity,
    "range_avg": range_avg,
    "incr_hype_index": lambda s, d: ix.hype_index(combined(s, d), CUT, exact=False),
    "incr_reality_index": lambda s, d: ix.reality_index(combined(s, d), CUT, exact=False),
    "incr_hype_index_exact": lambda s, d: ix.hype_index(combined(s, d), CUT),
    "incr_reality_index_exact": lambda s, d: ix.reality_index(combined(s, d), CUT),
    "incr_bubble": incr_bubble,
    "upsert_bubble": upsert_bubble,
    "refresh_bubble": refresh_bubble,
    "late_bubble": late_bubble,
    "entity_bubble_chunks": lambda s, d: ix.entity_bubble(ft.combined_features(*[f(x, 200) for f, x in zip((ft.hype_features, ft.reality_features), map(materialised, daily(s, d)))]), 200),
    "distinct_on": distinct_on,
    "top_risk": top_risk,
    "latest_per_entity": latest_per_entity,
    "top_intensity": top_intensity,
    "index_series": index_series,
    "latest_kpis": latest_kpis,
    "latest_point": latest_point,
    "date_gaps": date_gaps,
}.items()}

_HYPE_COLS = ["reddit_sentiment", "news_sentiment", "github_trending", "hf_trending", "arxiv_innovation"]
_COUNTS = "reddit_mentions, news_mentions, github_mentions, hf_mentions, research_mentions"
_REAL_COLS = ["stock_price", "trading_volume", "github_stars_delta", "github_forks_delta", "hf_downloads_delta"]
_HFEAT = [
    "reddit_sentiment_score", "news_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score", "reddit_sentiment_7d_avg", "news_sentiment_7d_avg", "reddit_sentiment_30d_avg",
    "news_sentiment_30d_avg", "github_trend_7d_avg", "hf_trend_7d_avg", "reddit_sentiment_momentum", "news_sentiment_momentum", "github_trending_momentum", "multi_source_hype_intensity", "trending_intensity",
]
_RFEAT = [
    *_REAL_COLS, "price_7d_avg", "github_stars_7d_delta", "hf_downloads_7d_delta", "price_30d_avg", "price_30d_growth", "github_delta_30d_growth", "hf_downloads_30d_growth",
    "github_stars_cumulative_delta", "hf_downloads_cumulative_delta", "reality_strength_score",
]
_BY_DATE = lambda c, n: f"(SELECT avg(a.{c}) FROM days a WHERE a.date <= d.date AND a.date > d.date - INTERVAL '{n} days')"

ORACLE_SQL = {
    "daily_hype": oracle(f"SELECT {IDS}, {r(*_HYPE_COLS)}, {_COUNTS} FROM dhype"),
    "star_join": oracle(f"SELECT {IDS}, {r(*_HYPE_COLS)}, {_COUNTS} FROM dhype"),
    "daily_reality": oracle(f"SELECT {IDS}, {r(*_REAL_COLS)} FROM dreal"),
    "hype_features": oracle(f"SELECT {IDS}, {_COUNTS}, {r(*_HFEAT)} FROM hfeat"),
    "reality_features": oracle(f"SELECT {IDS}, {r(*_RFEAT)} FROM rfeat"),
    "combined_features": oracle(f"SELECT {IDS}, {r(*COMBINED)} FROM comb"),
    "hype_weights": oracle(f"SELECT entity_id, entity_name, entity_type, {r('entity_weight')} FROM wh"),
    "reality_weights": oracle(f"SELECT entity_id, entity_name, entity_type, {r('entity_weight')} FROM wr"),
    "hype_index": oracle(f"SELECT time_id, date, entity_count, {r(*HINDEX)} FROM hidx"),
    "reality_index": oracle(f"SELECT time_id, date, entity_count, {r(*RINDEX)} FROM ridx"),
    "bubble_metrics": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM bubble"),
    "entity_bubble": oracle(f"SELECT {IDS}, {r(*ENTITY)} FROM ent"),
    "entity_bubble_chunks": oracle(f"SELECT {IDS}, {r(*ENTITY)} FROM ent"),
    "late_bubble": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM bubble"),
    "roll7": _W([(over("avg", c, 7), f"{c}_avg", "h") for c in ("reddit_sentiment", "github_trending", "hf_trending")]),
    "roll30": _W([(over("avg", c, 30), f"{c}_avg", "h") for c in ("reddit_sentiment", "github_trending", "hf_trending")]),
    "momentum7": _W([(change(c, 7), f"{c}_momentum", "h") for c in ("reddit_sentiment", "news_sentiment", "github_trending")]),
    "volatility30": _W([(over("stddev_samp", c, 30), f"{c}_volatility", "h") for c in ("reddit_sentiment", "news_sentiment")]),
    "growth30": _W([(change(c, 30), f"{c}_growth", "r") for c in ("stock_price", "github_stars_delta", "hf_downloads_delta")]),
    "cum_delta30": _W([(over("sum", c, 30), f"{c}_sum", "r") for c in ("github_stars_delta", "hf_downloads_delta")]),
    "pair_corr": oracle("""
SELECT date, entity_id, round(avg(CASE WHEN isnan(c) THEN NULL ELSE c END) + 1.37e-9, 6) + 0.0 AS correlation FROM (
  SELECT a.date, a.entity_id, corr(a.github_trending, b.github_trending) OVER (PARTITION BY a.entity_id, b.entity_id ORDER BY a.date ROWS 29 PRECEDING) AS c
  FROM dhype a JOIN dhype b ON a.date = b.date AND a.entity_id <> b.entity_id AND a.entity_type = 'software' AND b.entity_type = 'software')
GROUP BY date, entity_id"""),
    "norm_by_entity": oracle(f"SELECT date, entity_id, {r_as({'norm_hype_intensity': 'n_int', 'norm_reddit_momentum': 'n_red'})} FROM nh"),
    "range_avg": oracle(f"SELECT date, {r_as({f'{k}_{n}_days': _BY_DATE(k + '_index', n) for k in ('hype', 'reality') for n in (7, 30)})} FROM days d"),
    "incr_hype_index": oracle(f"SELECT time_id, date, entity_count, {r(*HINDEX)} FROM hidx_new"),
    "incr_reality_index": oracle(f"SELECT time_id, date, entity_count, {r(*RINDEX)} FROM ridx_new"),
    "incr_hype_index_exact": oracle(f"SELECT time_id, date, entity_count, {r(*HINDEX)} FROM hidx_after"),
    "incr_reality_index_exact": oracle(f"SELECT time_id, date, entity_count, {r(*RINDEX)} FROM ridx_after"),
    "incr_bubble": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM incr"),
    "upsert_bubble": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM (SELECT * FROM incr UNION ALL SELECT * FROM bubble WHERE date NOT IN (SELECT date FROM incr))"),
    "refresh_bubble": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM (SELECT * FROM bubble_first UNION ALL SELECT * FROM refreshed)"),
    "distinct_on": oracle(f"SELECT DISTINCT ON (month) month, date, time_id, {r('hype_index')} FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, * FROM bubble) ORDER BY month, date DESC"),
    "top_risk": oracle("""
SELECT entity_name, entity_type, round(round(coalesce(hype_score, 0), 2) + 1.37e-9, 6) + 0.0 AS hype_score, round(round(coalesce(reality_score, 0), 2) + 1.37e-9, 6) + 0.0 AS reality_score, round(round(coalesce(bubble_momentum, 0), 4) + 1.37e-9, 6) + 0.0 AS bubble_momentum
FROM (SELECT * FROM ent WHERE entity_name <> '' AND (hype_score IS NOT NULL OR reality_score IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, time_id DESC) = 1)
ORDER BY abs(coalesce(bubble_momentum, 0)) DESC, entity_name LIMIT 10"""),
    "latest_per_entity": oracle(f"SELECT entity_id, date, entity_name, {r('hype_score', 'reality_score', 'bubble_momentum')} FROM ent WHERE entity_name <> '' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, time_id DESC) = 1"),
    "top_intensity": oracle(f"SELECT date, entity_name, entity_type, {r('multi_source_hype_intensity', 'reality_strength_score', 'hype_reality_gap')} FROM comb WHERE entity_name IS NOT NULL ORDER BY round(comb.multi_source_hype_intensity, 6) DESC, date, entity_id LIMIT 5"),
    "index_series": oracle(f"SELECT date, {r('hype_index', 'reality_index', 'hype_reality_gap', 'bubble_risk_score')} FROM bubble WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"),
    "latest_kpis": oracle(f"SELECT (SELECT count(*) FROM bubble) AS points, date AS last_date, {r('hype_index', 'reality_index', 'hype_reality_gap')} FROM bubble ORDER BY date DESC LIMIT 1"),
    "latest_point": oracle(f"SELECT date, time_id, {r(*BUBBLE)} FROM bubble ORDER BY date DESC LIMIT 1"),
    "date_gaps": oracle("SELECT * FROM (SELECT entity_id, date, lead(date) OVER w AS next_date, CAST(lead(date) OVER w - date AS INT) AS gap_days FROM dhype WINDOW w AS (PARTITION BY entity_id ORDER BY date)) WHERE gap_days > 7"),
}
