"""Shared pieces of the DuckDB oracles: named table expressions that depend on each other, and rounding."""

from __future__ import annotations

import re

from ..functions.expr import QUOTIENTS, SHIFT

#: Name to SQL. A later entry may read earlier ones.
TABLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    TABLES[name] = sql.strip()


def oracle(select: str) -> str:
    """``select`` with all the table expressions that it needs, in order of definition."""
    needed: set[str] = set()

    def need(sql: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                need(TABLES[name])

    need(select)
    parts = ", ".join(f"{n} AS ({TABLES[n]})" for n in TABLES if n in needed)
    return (f"WITH {parts} " if parts else "") + select.strip()


def r(*columns: str) -> str:
    """Select items: doubles rounded as in ``functions.expr.rounded``."""

    def one(c: str) -> str:
        fine = f"round({c} + {SHIFT}, 6) + 0.0"
        return f"CASE WHEN abs({c}) >= 1000 THEN round({c} + {SHIFT}, 1) ELSE {fine} END AS {c}" if c in QUOTIENTS else f"{fine} AS {c}"

    return ", ".join(map(one, columns))


def r_as(items: dict[str, str]) -> str:
    """As :func:`r`, for expressions by name."""
    return ", ".join(f"round({e} + {SHIFT}, 6) + 0.0 AS {n}" for n, e in items.items())


def z(c: str) -> str:
    return f"coalesce({c}, 0.0)"


# Signals from the sales tables -------------------------------------------------------------------------------------

define("sold", """
SELECT CAST(l.l_shipdate AS DATE) AS date, p.p_brand AS brand, p.p_type AS kind, 'nation-' || s.s_nationkey AS nation, 'size-' || (p.p_size % 5) AS size,
       l.l_quantity AS q, round(l.l_discount * 100) AS disc, round(l.l_tax * 100) AS tax, l.l_returnflag AS flag, l.l_linestatus AS status,
       round(l.l_extendedprice / nullif(l.l_quantity, 0)) AS price, l.l_linenumber AS line
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
define("times", """
SELECT row_number() OVER (ORDER BY date) AS time_id, date FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) WHERE date IS NOT NULL""")
define("entities", """
SELECT row_number() OVER (ORDER BY name, entity_type, ticker, industry) AS entity_id, * FROM (
  SELECT p_brand AS name, p_brand AS ticker, 'company' AS entity_type, 'technology' AS industry FROM part
  UNION SELECT p_type, p_type, 'software', 'ai_infrastructure' FROM part
  UNION SELECT 'nation-' || s_nationkey, 'nation-' || s_nationkey, 'ai_model', 'general' FROM supplier
  UNION SELECT 'size-' || (p_size % 5), 'size-' || (p_size % 5), 'research', 'academic' FROM part)
WHERE name IS NOT NULL""")
define("sources", "SELECT * FROM (VALUES (1, 'reddit', 'social'), (2, 'news', 'media'), (3, 'github', 'repository'), (4, 'huggingface', 'model_hub'), (5, 'arxiv', 'research'), (6, 'yfinance', 'market'), (7, 'sec', 'regulatory')) v(source_id, source_name, source_type)")
define("hype_signals", """
SELECT date, 'company' AS et, brand AS name, 1 AS source_id, 'sentiment' AS signal_type, 'reddit_ai_sentiment' AS metric_name, (2 * disc - 9) / 16 AS v FROM sold WHERE flag <> 'N'
UNION ALL SELECT date, 'company', brand, 2, 'sentiment', 'news_ai_sentiment', (2 * tax - 7) / 16 FROM sold WHERE status = 'O'
UNION ALL SELECT date, 'software', kind, 3, 'trending', 'github_trending_score', q / 64 FROM sold
UNION ALL SELECT date, 'ai_model', nation, 4, 'trending', 'huggingface_trending_score', q / 64 FROM sold
UNION ALL SELECT date, 'ai_model', nation, 5, 'innovation', 'arxiv_innovation_score', disc / 16 FROM sold
UNION ALL SELECT date, 'research', size, 5, 'innovation', 'arxiv_innovation_score', disc / 16 FROM sold""")
define("reality_signals", """
SELECT date, 'company' AS et, brand AS name, 'yfinance' AS prov, 'USD' AS unit, 'stock_price' AS metric_name, price AS v FROM sold
UNION ALL SELECT date, 'company', brand, 'yfinance', 'shares', 'trading_volume', q FROM sold
UNION ALL SELECT date, 'software', kind, 'github', 'count', 'github_stars_delta', q - 25 FROM sold
UNION ALL SELECT date, 'software', kind, 'github', 'count', 'github_forks_delta', line - 3 FROM sold
UNION ALL SELECT date, 'ai_model', nation, 'huggingface', 'count', 'model_downloads_delta', q - 25 FROM sold""")
define("hfacts", "SELECT t.time_id, e.entity_id, x.source_id, x.signal_type, x.metric_name, CAST(x.v AS DOUBLE) AS metric_value FROM hype_signals x JOIN times t ON x.date = t.date JOIN entities e ON x.name = e.name AND x.et = e.entity_type WHERE x.v IS NOT NULL")
define("rfacts", "SELECT t.time_id, e.entity_id, x.metric_name, CAST(x.v AS DOUBLE) AS metric_value, x.unit AS metric_unit, x.prov AS provenance FROM reality_signals x JOIN times t ON x.date = t.date JOIN entities e ON x.name = e.name AND x.et = e.entity_type WHERE x.v IS NOT NULL")

# Features ----------------------------------------------------------------------------------------------------------

_HYPE = [("reddit_ai_sentiment", "reddit_sentiment", "reddit_mentions"), ("news_ai_sentiment", "news_sentiment", "news_mentions"), ("github_trending_score", "github_trending", "github_mentions"), ("huggingface_trending_score", "hf_trending", "hf_mentions"), ("arxiv_innovation_score", "arxiv_innovation", "research_mentions")]
_REAL = [("stock_price", "stock_price"), ("trading_volume", "trading_volume"), ("github_stars_delta", "github_stars_delta"), ("github_forks_delta", "github_forks_delta"), ("model_downloads_delta", "hf_downloads_delta")]
_IDS = "time_id, date, entity_id, entity_name, entity_type"
_PER_DAY = "FROM {f} f JOIN times t USING (time_id) JOIN entities e USING (entity_id) GROUP BY ALL"

define("dhype", "SELECT t.time_id, t.date, e.entity_id, e.name AS entity_name, e.entity_type, " + ", ".join(f"avg(metric_value) FILTER (metric_name = '{m}') AS {c}" for m, c, _ in _HYPE) + ", " + ", ".join(f"count(*) FILTER (metric_name = '{m}') AS {n}" for m, _, n in _HYPE) + " " + _PER_DAY.format(f="hfacts"))
define("dreal", "SELECT t.time_id, t.date, e.entity_id, e.name AS entity_name, e.entity_type, " + ", ".join(f"avg(metric_value) FILTER (metric_name = '{m}') AS {c}" for m, c in _REAL) + " " + _PER_DAY.format(f="rfacts"))


def over(f: str, c: str, n: int) -> str:
    return f"{f}({c}) OVER (PARTITION BY entity_id ORDER BY date ROWS {n - 1} PRECEDING)"


def change(c: str, n: int) -> str:
    then = f"lag({c}, {n}) OVER (PARTITION BY entity_id ORDER BY date)"
    return f"({c} - {then}) / nullif({then}, 0)"


define("hw", "SELECT *, " + ", ".join(
    [f"{over('avg', c, 7)} AS {c}_7" for c in ("reddit_sentiment", "news_sentiment", "github_trending", "hf_trending")]
    + [f"{over('avg', c, 30)} AS {c}_30" for c in ("reddit_sentiment", "news_sentiment")]
    + [f"{change(c, 7)} AS {c}_change" for c in ("reddit_sentiment", "news_sentiment", "github_trending")]
) + " FROM dhype")
define("hfeat", f"""
SELECT {_IDS}, {z('reddit_sentiment')} AS reddit_sentiment_score, {z('news_sentiment')} AS news_sentiment_score, {z('github_trending')} AS github_trending_score,
  {z('hf_trending')} AS hf_trending_score, {z('arxiv_innovation')} AS arxiv_innovation_score, reddit_mentions, news_mentions, github_mentions, hf_mentions, research_mentions,
  {z('reddit_sentiment_7')} AS reddit_sentiment_7d_avg, {z('news_sentiment_7')} AS news_sentiment_7d_avg, {z('reddit_sentiment_30')} AS reddit_sentiment_30d_avg,
  {z('news_sentiment_30')} AS news_sentiment_30d_avg, {z('github_trending_7')} AS github_trend_7d_avg, {z('hf_trending_7')} AS hf_trend_7d_avg,
  {z('reddit_sentiment_change')} AS reddit_sentiment_momentum, {z('news_sentiment_change')} AS news_sentiment_momentum, {z('github_trending_change')} AS github_trending_momentum,
  ({z('reddit_sentiment_7')} + {z('news_sentiment_7')} + {z('github_trending_7')} + {z('hf_trending_7')}) * 0.25 AS multi_source_hype_intensity,
  ({z('github_trending_7')} * github_mentions + {z('hf_trending_7')} * hf_mentions) / nullif(github_mentions + hf_mentions, 0) AS trending_intensity
FROM hw""")
define("rw", "SELECT *, " + ", ".join(
    [f"{over('avg', 'stock_price', 7)} AS p7", f"{over('avg', 'github_stars_delta', 7)} AS s7", f"{over('avg', 'hf_downloads_delta', 7)} AS d7", f"{over('avg', 'stock_price', 30)} AS p30"]
    + [f"{z(change(c, 30))} AS {g}" for c, g in (("stock_price", "pg"), ("github_stars_delta", "sg"), ("hf_downloads_delta", "dg"))]
    + [f"{over('sum', 'github_stars_delta', 30)} AS ss", f"{over('sum', 'hf_downloads_delta', 30)} AS ds"]
) + " FROM dreal")
define("rfeat", f"""
SELECT {_IDS}, {', '.join(f'{z(c)} AS {c}' for _, c in _REAL)}, {z('p7')} AS price_7d_avg, {z('s7')} AS github_stars_7d_delta, {z('d7')} AS hf_downloads_7d_delta, {z('p30')} AS price_30d_avg,
  pg AS price_30d_growth, sg AS github_delta_30d_growth, dg AS hf_downloads_30d_growth, {z('ss')} AS github_stars_cumulative_delta, {z('ds')} AS hf_downloads_cumulative_delta,
  CASE entity_type WHEN 'company' THEN pg * 0.4 + sg * 0.3 + dg * 0.3 WHEN 'software' THEN sg WHEN 'ai_model' THEN dg ELSE sg + dg END AS reality_strength_score
FROM rw""")
COMBINED = [
    "reddit_sentiment_score", "news_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score", "reddit_sentiment_momentum", "news_sentiment_momentum", "github_trending_momentum",
    "multi_source_hype_intensity", "trending_intensity", "stock_price", "trading_volume", "github_stars_delta", "github_forks_delta", "hf_downloads_delta", "price_30d_growth", "github_delta_30d_growth",
    "hf_downloads_30d_growth", "github_stars_cumulative_delta", "hf_downloads_cumulative_delta", "hype_intensity_score", "reality_strength_score", "hype_reality_gap", "hype_reality_ratio", "trending_reality_gap",
    "innovation_adoption_gap",
]
define("comb", f"""
SELECT h.time_id, h.date, h.entity_id, h.entity_name, h.entity_type, {', '.join(('h.' if i < 10 else 'r.') + c for i, c in enumerate(COMBINED[:20]))},
  h.multi_source_hype_intensity AS hype_intensity_score, r.reality_strength_score, h.multi_source_hype_intensity - r.reality_strength_score AS hype_reality_gap,
  CASE WHEN r.reality_strength_score = 0 THEN 0 ELSE h.multi_source_hype_intensity / r.reality_strength_score END AS hype_reality_ratio,
  h.trending_intensity - r.github_delta_30d_growth AS trending_reality_gap, h.arxiv_innovation_score - r.hf_downloads_30d_growth AS innovation_adoption_gap
FROM hfeat h JOIN rfeat r USING (time_id, entity_id)""")

# Indices -----------------------------------------------------------------------------------------------------------

define("wh", f"""
SELECT entity_id, entity_name, entity_type, CASE entity_type WHEN 'company' THEN (avg(multi_source_hype_intensity) + avg({z('trending_intensity')})) * 2
  WHEN 'software' THEN (avg(github_trending_score) + avg(hf_trending_score)) * 1.5 WHEN 'ai_model' THEN (avg(hf_trending_score) + avg(arxiv_innovation_score * 100)) * 1.3
  ELSE avg(arxiv_innovation_score) + avg(multi_source_hype_intensity) END AS entity_weight FROM comb GROUP BY entity_id, entity_name, entity_type""")
define("wr", """
SELECT entity_id, entity_name, entity_type, CASE entity_type WHEN 'company' THEN (avg(stock_price) + avg(abs(github_stars_delta)) * 100 + avg(abs(hf_downloads_delta)) * 50) * 2
  WHEN 'software' THEN avg(abs(github_stars_delta)) * 100 + avg(abs(github_forks_delta)) * 50 WHEN 'ai_model' THEN avg(hf_downloads_delta) * 50 + avg(abs(hf_downloads_delta)) * 100
  ELSE avg(abs(github_stars_delta)) * 100 + avg(abs(hf_downloads_delta)) * 50 END AS entity_weight FROM comb GROUP BY entity_id, entity_name, entity_type""")


def norm(c: str, size: bool) -> str:
    inner = f"abs({c})" if size else c
    return f"coalesce({c} / nullif(max({inner}) OVER (PARTITION BY entity_id), 0), 0)"


_NH = [("n_int", "multi_source_hype_intensity", False), ("n_red", "reddit_sentiment_momentum", True), ("n_news", "news_sentiment_momentum", True), ("n_git", "github_trending_momentum", True), ("n_trend", "trending_intensity", False), ("n_inn", "arxiv_innovation_score", False)]
_NR = [("n_str", "reality_strength_score", False), ("n_price", "price_30d_growth", True), ("n_star", "github_delta_30d_growth", True), ("n_down", "hf_downloads_30d_growth", True), ("n_cs", "github_stars_cumulative_delta", True), ("n_cd", "hf_downloads_cumulative_delta", True)]
CUT = "1999-06-30"

for name, rows, weight, norms in (("nh", "comb", "wh", _NH), ("nr", "comb", "wr", _NR), ("nh_new", "comb", "wh", _NH), ("nr_new", "comb", "wr", _NR)):
    where = f" WHERE date > DATE '{CUT}'" if name.endswith("_new") else ""
    define(name, f"SELECT c.*, w.entity_weight AS w, {', '.join(f'{norm(c, s)} AS {n}' for n, c, s in norms)} FROM {rows} c JOIN {weight} w USING (entity_id){where}")

HINDEX = ["hype_index", "hype_intensity_component", "sentiment_momentum_component", "github_trending_component", "trending_component", "innovation_component", "total_mentions_proxy"]
RINDEX = ["reality_index", "reality_strength_component", "price_growth_component", "github_delta_component", "hf_downloads_component", "cumulative_impact_component", "avg_company_growth", "avg_github_momentum", "avg_hf_momentum"]


def _weighted(x: str, name: str) -> str:
    return f"sum(w * ({x})) / nullif(sum(w), 0) AS {name}"


for name, rows in (("hidx", "nh"), ("hidx_new", "nh_new"), ("hidx_after", f"(SELECT * FROM nh WHERE date > DATE '{CUT}')")):
    define(name, f"""
SELECT time_id, date, {_weighted('n_int * 0.25 + (n_red + n_news) * 0.2 + n_git * 0.15 + n_trend * 0.15 + n_inn * 0.25', 'hype_index')}, {_weighted('n_int', 'hype_intensity_component')},
  {_weighted('(n_red + n_news) / 2', 'sentiment_momentum_component')}, {_weighted('n_git', 'github_trending_component')}, {_weighted('n_trend', 'trending_component')}, {_weighted('n_inn', 'innovation_component')},
  count(DISTINCT entity_id) AS entity_count, sum(multi_source_hype_intensity + {z('trending_intensity')}) AS total_mentions_proxy FROM {rows} GROUP BY time_id, date""")
for name, rows in (("ridx", "nr"), ("ridx_new", "nr_new"), ("ridx_after", f"(SELECT * FROM nr WHERE date > DATE '{CUT}')")):
    define(name, f"""
SELECT time_id, date, {_weighted('n_str * 0.3 + n_price * 0.2 + n_star * 0.25 + n_down * 0.25', 'reality_index')}, {_weighted('n_str', 'reality_strength_component')}, {_weighted('n_price', 'price_growth_component')},
  {_weighted('n_star', 'github_delta_component')}, {_weighted('n_down', 'hf_downloads_component')}, {_weighted('(n_cs + n_cd) / 2', 'cumulative_impact_component')}, count(DISTINCT entity_id) AS entity_count,
  avg(price_30d_growth) FILTER (entity_type = 'company') AS avg_company_growth, avg(abs(github_delta_30d_growth)) AS avg_github_momentum, avg(abs(hf_downloads_30d_growth)) AS avg_hf_momentum FROM {rows} GROUP BY time_id, date""")

BUBBLE = ["hype_index", "reality_index", "hype_7d_avg", "reality_7d_avg", "hype_30d_avg", "reality_30d_avg", "hype_reality_gap", "hype_reality_ratio", "bubble_momentum", "sentiment_bubble_momentum", "github_trending_bubble_momentum", "trending_reality_divergence", "hype_score", "reality_score", "bubble_risk_score"]


def score(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {high} = {low} THEN 50.0 ELSE 100 * ({x} - {low}) / nullif({high} - {low}, 0) END"


def bubble_sql(rows: str) -> str:
    return f"""
SELECT date, time_id, hype_index, reality_index, hype_7d_avg, reality_7d_avg, hype_30d_avg, reality_30d_avg, hype_index - reality_index AS hype_reality_gap,
  CASE WHEN reality_index = 0 THEN 0 ELSE hype_index / reality_index END AS hype_reality_ratio, (hype_7d_avg - reality_7d_avg) - (hype_30d_avg - reality_30d_avg) AS bubble_momentum,
  s7 - st7 AS sentiment_bubble_momentum, g7 - gd7 AS github_trending_bubble_momentum, trending_component - cumulative_impact_component AS trending_reality_divergence,
  {score('hype_index', 'h_low', 'h_high')} AS hype_score, {score('reality_index', 'r_low', 'r_high')} AS reality_score,
  (abs(hype_index - reality_index) * 0.4 + abs((hype_7d_avg - reality_7d_avg) - (hype_30d_avg - reality_30d_avg)) * 0.3 + abs(trending_component - cumulative_impact_component) * 0.3) * 100 AS bubble_risk_score
FROM ({rows})"""


_DAYS = "SELECT h.* EXCLUDE (entity_count), r.* EXCLUDE (time_id, date, entity_count) FROM {h} h JOIN {r} r ON h.date = r.date QUALIFY row_number() OVER (PARTITION BY h.date ORDER BY h.time_id DESC) = 1"
define("days", _DAYS.format(h="hidx", r="ridx"))
define("days_new", _DAYS.format(h="hidx_new", r="ridx_new"))


def _rows(c: str, n: int) -> str:
    return f"avg({c}) OVER (ORDER BY date ROWS {n - 1} PRECEDING)"


define("bubble", bubble_sql("SELECT *, " + ", ".join(f"{_rows(k + '_index', n)} AS {k}_{n}d_avg" for k in ("hype", "reality") for n in (7, 30)) + f", {_rows('sentiment_momentum_component', 7)} AS s7, {_rows('github_trending_component', 7)} AS g7, {_rows('reality_strength_component', 7)} AS st7, {_rows('github_delta_component', 7)} AS gd7, min(hype_index) OVER () AS h_low, max(hype_index) OVER () AS h_high, min(reality_index) OVER () AS r_low, max(reality_index) OVER () AS r_high FROM days"))
define("old_bubble", f"SELECT * FROM bubble WHERE date <= DATE '{CUT}'")
define("history", "SELECT date, hype_index, reality_index FROM old_bubble UNION ALL SELECT date, hype_index, reality_index FROM days_new")


def _calendar(c: str, n: int, table: str) -> str:
    return f"(SELECT avg(a.{c}) FROM {table} a WHERE a.date <= d.date AND a.date > d.date - INTERVAL '{n} days')"


define("incr", bubble_sql("SELECT d.*, " + ", ".join(f"{_calendar(k + '_index', n, 'history')} AS {k}_{n}d_avg" for k in ("hype", "reality") for n in (7, 30)) + f", {_calendar('sentiment_momentum_component', 7, 'days_new')} AS s7, {_calendar('github_trending_component', 7, 'days_new')} AS g7, {_calendar('reality_strength_component', 7, 'days_new')} AS st7, {_calendar('github_delta_component', 7, 'days_new')} AS gd7, (SELECT min(hype_index) FROM old_bubble) AS h_low, (SELECT max(hype_index) FROM old_bubble) AS h_high, (SELECT min(reality_index) FROM old_bubble) AS r_low, (SELECT max(reality_index) FROM old_bubble) AS r_high FROM days_new d"))

ENTITY = ["multi_source_hype_intensity", "reality_strength_score", "hype_7d_avg", "reality_7d_avg", "hype_30d_avg", "reality_30d_avg", "hype_reality_gap", "hype_reality_ratio", "bubble_momentum", "reddit_sentiment_score", "github_trending_score", "hf_trending_score", "arxiv_innovation_score", "github_stars_delta", "hf_downloads_delta", "github_trending_momentum", "hf_trending_momentum", "hype_score", "reality_score"]
define("ent0", "SELECT *, " + ", ".join(f"{over('avg', c, n)} AS {k}_{n}d_avg" for k, c in (("hype", "multi_source_hype_intensity"), ("reality", "reality_strength_score")) for n in (7, 30)) + " FROM comb")
_part = "OVER (PARTITION BY entity_id)"
define("ent", f"""
SELECT {_IDS}, multi_source_hype_intensity, reality_strength_score, hype_7d_avg, reality_7d_avg, hype_30d_avg, reality_30d_avg, hype_reality_gap, hype_reality_ratio,
  (hype_7d_avg - reality_7d_avg) - (hype_30d_avg - reality_30d_avg) AS bubble_momentum, reddit_sentiment_score, github_trending_score, hf_trending_score, arxiv_innovation_score, github_stars_delta, hf_downloads_delta,
  github_trending_score - lag(github_trending_score, 7) OVER (PARTITION BY entity_id ORDER BY date) AS github_trending_momentum,
  hf_trending_score - lag(hf_trending_score, 7) OVER (PARTITION BY entity_id ORDER BY date) AS hf_trending_momentum,
  {score('multi_source_hype_intensity', f'min(multi_source_hype_intensity) {_part}', f'max(multi_source_hype_intensity) {_part}')} AS hype_score,
  {score('reality_strength_score', f'min(reality_strength_score) {_part}', f'max(reality_strength_score) {_part}')} AS reality_score
FROM ent0""")
