"""Detection over daily events, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import detect as dt
from ..operators import quality as dq
from ..operators import serving as sv
from ..sources import adapters as ad
from .sqlkit import define, oracle, r, r_as

#: Templates of ``template_alerts``.
EPISODES = 5

define("ev", "SELECT user_id AS entity_id, CAST(ts AS DATE) AS date, count(*) FILTER (event_type IN ('view', 'click'))::DOUBLE AS hype, count(*) FILTER (event_type = 'purchase')::DOUBLE AS reality FROM events GROUP BY ALL")
define("ev_n", "SELECT *, count(*) OVER (PARTITION BY entity_id) AS all_n, row_number() OVER (PARTITION BY entity_id ORDER BY date) AS rn FROM ev")
define("rstats", "SELECT entity_id, count(*) AS n, quantile_cont(hype, 0.5) AS hype_median, quantile_cont(hype, 0.75) - quantile_cont(hype, 0.25) AS hype_iqr, quantile_cont(reality, 0.5) AS reality_median, quantile_cont(reality, 0.75) - quantile_cont(reality, 0.25) AS reality_iqr FROM ev GROUP BY entity_id")
define("diverg", "SELECT entity_id, date, hype, reality, rn, all_n, (hype - hype_median) / CASE WHEN hype_iqr = 0 THEN 1 ELSE hype_iqr END - (reality - reality_median) / CASE WHEN reality_iqr = 0 THEN 1 ELSE reality_iqr END AS divergence FROM ev_n JOIN rstats USING (entity_id)")
define("accel0", "SELECT *, divergence - 2 * lag(divergence, 1) OVER w + lag(divergence, 2) OVER w AS second FROM diverg WINDOW w AS (PARTITION BY entity_id ORDER BY date)")
define("accel", "SELECT a.entity_id, a.date, a.rn, a.all_n, any_value(a.divergence) AS divergence, any_value(a.second) AS second, sum(b.second * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn)) AS acceleration FROM accel0 a LEFT JOIN accel0 b ON a.entity_id = b.entity_id AND b.rn <= a.rn AND b.second IS NOT NULL GROUP BY a.entity_id, a.date, a.rn, a.all_n")
_z = lambda x: f"CASE WHEN stddev_pop({x}) OVER (PARTITION BY entity_id) > 1e-12 THEN ({x} - avg({x}) OVER (PARTITION BY entity_id)) / stddev_pop({x}) OVER (PARTITION BY entity_id) END"
define("zs", f"SELECT entity_id, date, rn, all_n, {_z('divergence')} AS divergence_z, {_z('coalesce(acceleration, 0)')} AS acceleration_z FROM accel WHERE all_n >= 5")


def _alerts_sql(rows: str) -> str:
    return f"""
SELECT CAST(date AS TIMESTAMP) AS timestamp, entity_id, 'watch' AS alert_level, coalesce(divergence_z, 0) AS divergence_score, coalesce(acceleration_z, 0) AS acceleration_score, 0.0 AS pattern_score,
  1 / (1 + exp(5 - (0.5 * abs(coalesce(divergence_z, 0)) + 0.3 * abs(coalesce(acceleration_z, 0))))) AS confidence
FROM ({rows}) WHERE coalesce(divergence_z, 0) - 1e-9 > 1.5 OR coalesce(acceleration_z, 0) - 1e-9 > 2.0"""


define("alerted", _alerts_sql("SELECT * FROM zs WHERE rn = all_n"))
define("ev_all", f"SELECT * FROM ev UNION ALL SELECT {dt.EVERYONE}, date, sum(hype), sum(reality) FROM ev GROUP BY date")
_zz = lambda x: f"CASE WHEN stddev_pop({x}) OVER (PARTITION BY day, entity_id) > 1e-9 THEN ({x} - avg({x}) OVER (PARTITION BY day, entity_id)) / stddev_pop({x}) OVER (PARTITION BY day, entity_id) END"


def _asof(ev: str, tail: str = "") -> None:
    """Every date's history of an entity of ``ev``, scored from scratch: ``asof_rows`` + ``tail``."""
    t = tail
    define(f"cutoff{t}", f"SELECT d.day, e.* FROM (SELECT DISTINCT date AS day FROM {ev}) d JOIN {ev} e ON e.date <= d.day")
    define(f"pre0{t}", f"SELECT *, count(*) OVER (PARTITION BY day, entity_id) AS all_n, row_number() OVER (PARTITION BY day, entity_id ORDER BY date) AS rn FROM cutoff{t}")
    define(f"prestat{t}", f"SELECT day, entity_id, quantile_cont(hype, 0.5) AS hm, quantile_cont(hype, 0.75) - quantile_cont(hype, 0.25) AS hi, quantile_cont(reality, 0.5) AS rm, quantile_cont(reality, 0.75) - quantile_cont(reality, 0.25) AS ri FROM cutoff{t} GROUP BY ALL")
    define(f"pre1{t}", f"SELECT p.*, (hype - hm) / CASE WHEN hi = 0 THEN 1 ELSE hi END - (reality - rm) / CASE WHEN ri = 0 THEN 1 ELSE ri END AS dv FROM pre0{t} p JOIN prestat{t} USING (day, entity_id) WHERE all_n >= 5")
    define(f"pre2{t}", f"SELECT *, dv - 2 * lag(dv, 1) OVER w + lag(dv, 2) OVER w AS second FROM pre1{t} WINDOW w AS (PARTITION BY day, entity_id ORDER BY date)")
    define(f"pre3{t}", f"SELECT a.day, a.entity_id, a.rn, a.all_n, any_value(a.dv) AS dv, coalesce(sum(b.second * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn)), 0) AS ac FROM pre2{t} a LEFT JOIN pre2{t} b ON a.day = b.day AND a.entity_id = b.entity_id AND b.rn <= a.rn AND b.second IS NOT NULL GROUP BY a.day, a.entity_id, a.rn, a.all_n")
    define(f"asof_scored{t}", f"SELECT day AS date, entity_id, divergence_z, acceleration_z FROM (SELECT day, entity_id, rn, all_n, {_zz('dv')} AS divergence_z, {_zz('ac')} AS acceleration_z FROM pre3{t}) WHERE rn = all_n")
    define(f"asof_rows{t}", _alerts_sql(f"SELECT * FROM asof_scored{t}"))


_asof("ev")
_asof("ev_all", "_all")

# the least warped distance of each series to some template, row by row of the table of costs
_unit = lambda x, by: f"list(CASE WHEN sd > 0 THEN ({x} - mean) / sd ELSE 0.0 END ORDER BY pos) FROM (SELECT *, avg({x}) OVER (PARTITION BY {by}) AS mean, stddev_samp({x}) OVER (PARTITION BY {by}) AS sd FROM "
define("own_shape", f"SELECT entity_id, {_unit('divergence', 'entity_id').replace(' FROM', ' AS xs FROM', 1)} (SELECT *, date AS pos FROM diverg)) GROUP BY entity_id")
define("means3", "SELECT entity_id % 3 AS template, date AS pos, avg(divergence) AS v FROM diverg GROUP BY ALL")
define("episodes", f"SELECT entity_id FROM asof_scored WHERE divergence_z IS NOT NULL GROUP BY entity_id ORDER BY round(max(divergence_z), 6) DESC, entity_id LIMIT {EPISODES}")
define("peaks", "SELECT entity_id AS template, date AS pos, divergence AS v FROM diverg JOIN episodes USING (entity_id)")
for name, rows in (("warped", "means3"), ("warped_peaks", "peaks")):
    define(f"{name}_shape", f"SELECT template, {_unit('v', 'template').replace(' FROM', ' AS ts FROM', 1)} {rows}) GROUP BY template")
    define(name, f"""
SELECT entity_id, 1 / (1 + sqrt(min(cost))) AS pattern FROM (
  SELECT entity_id, list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_transform(ts, lambda t: 'inf'::DOUBLE)), list_transform(xs, lambda x: [x])), lambda above, x:
    list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, len(ts) + 1), lambda j: [pow(x[1] - ts[j], 2), least(above[j], above[j + 1])])), lambda done, c: list_append(done, c[1] + least(c[2], done[-1]))))[-1] AS cost
  FROM own_shape CROSS JOIN {name}_shape) GROUP BY entity_id""")

# binary segmentation, round by round
define("cp_rows0", "SELECT entity_id, date, divergence AS x, 0 AS seg FROM diverg")
for k in range(5):
    define(f"cp_best{k}", f"""
SELECT entity_id, CAST({k + 1} AS INT) AS round, date, seg, gain FROM (SELECT *, t * t / k + (total - t) * (total - t) / nullif(n - k, 0) - total * total / n AS gain FROM (
  SELECT *, count(*) OVER whole AS n, sum(x) OVER whole AS total, row_number() OVER upto AS k, sum(x) OVER upto AS t FROM cp_rows{k}
  WINDOW whole AS (PARTITION BY entity_id, seg), upto AS (PARTITION BY entity_id, seg ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE k < n)
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(gain, 9) DESC, date) = 1""")
    define(f"cp_rows{k + 1}", f"SELECT a.entity_id, a.date, a.x, CASE WHEN a.seg = b.seg AND a.date > b.date THEN {k + 1} ELSE a.seg END AS seg FROM cp_rows{k} a LEFT JOIN cp_best{k} b USING (entity_id)")

# a lag of 1: residual sums by centred moments, and the tail of a chi-square with one degree of freedom by a series
define("lag1", "SELECT entity_id, reality AS y, lag(reality) OVER w AS a, lag(hype) OVER w AS b FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY date)")
define("lag1_sums", "SELECT entity_id, count(*) AS n, " + ", ".join(f"count(*) * covar_pop({p}, {q}) AS {p}{q}" for p, q in ("yy", "aa", "bb", "ya", "yb", "ab")) + " FROM lag1 WHERE a IS NOT NULL GROUP BY entity_id HAVING count(*) > 3")
define("lag1_fit", """
SELECT entity_id, n, yy - CASE WHEN aa > 1e-9 THEN ya * ya / aa ELSE 0 END AS small, yy - CASE WHEN aa * bb - ab * ab > 1e-9 THEN (bb * ya * ya - 2 * ab * ya * yb + aa * yb * yb) / (aa * bb - ab * ab)
  WHEN aa > 1e-9 THEN ya * ya / aa WHEN bb > 1e-9 THEN yb * yb / bb ELSE 0 END AS whole FROM lag1_sums""")
define("lag1_root", "SELECT entity_id, CASE WHEN whole > 1e-9 THEN sqrt(greatest(n * (small - whole) / whole, 0) / 2) WHEN small <= 1e-9 THEN 0 ELSE 40 END AS t FROM lag1_fit")

_ALERT = ["divergence_score", "acceleration_score", "pattern_score", "confidence"]
_ALERT_SQL = f"SELECT timestamp, entity_id, alert_level, {r(*_ALERT)} FROM "


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return ad.daily_events(spark, sf)


def _plain(alerts: DataFrame) -> DataFrame:
    return alerts.drop("contributing_factors")


def templates(rows: DataFrame) -> DataFrame:
    """Three shapes taken from the data: the mean divergence by day of entities 0, 1 and 2 modulo 3."""
    return rows.groupBy((F.col("entity_id") % 3).cast("string").alias("template"), F.unix_date("date").alias("pos")).agg(F.avg("divergence").alias("value"))


def pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = dt.divergence(_ev(spark, sf))
    return dt.pattern_match(rows, templates(rows))


def episodes(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """The series of the ``EPISODES`` entities that stood out most on any day, each a template."""
    most = scores.groupBy("entity_id").agg(F.max("divergence_z").alias("z")).where("z is not null")
    top = most.orderBy(F.desc(F.round("z", 6)), "entity_id").limit(EPISODES).select("entity_id")
    return rows.join(top, "entity_id").select(F.col("entity_id").cast("string").alias("template"), F.unix_date("date").alias("pos"), F.col("divergence").alias("value"))


def template_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts as of each day, graded by the nearest known episode, too."""
    rows = _ev(spark, sf)
    series = dt.divergence(rows)
    return _plain(dt.asof_alerts(rows, dt.pattern_match(series, episodes(dt.asof_scores(rows), series))))


def asof_alerts_global(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts as of each day, of the users and of all users together."""
    rows = _ev(spark, sf)
    overall = rows.groupBy("date").agg(F.sum("hype").alias("hype"), F.sum("reality").alias("reality"))
    return _plain(dt.asof_alerts(dt.include_global(rows, overall)))


def save_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = dt.asof_alerts(_ev(spark, sf))
    known = found.where(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"))
    return _plain(dt.save_alerts(found.unionByName(found), known))


def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    users = ad.daily_events(spark, sf).select("entity_id").distinct().where("entity_id % 10 <> 3")
    return sv.recent_alerts(dt.asof_alerts(_ev(spark, sf)), users.withColumn("name", F.concat(F.lit("user-"), "entity_id")), "2024-01-30", 7)


def null_scores(spark: SparkSession, sf: str) -> DataFrame:
    return dq.bad_scores(dt.scored(_ev(spark, sf)), "entity_id", ["divergence_z", "acceleration"])


def _rounding(f):
    return lambda spark, sf: rounded(f(spark, sf))


QUERIES = {k: _rounding(f) for k, f in {
    "sufficient": lambda s, d: dt.sufficient(_ev(s, d), 25),
    "semi_sufficient": lambda s, d: dt.with_enough(_ev(s, d), 25),
    "robust_stats": lambda s, d: dt.robust_stats(_ev(s, d)),
    "divergence": lambda s, d: dt.divergence(_ev(s, d)),
    "acceleration": lambda s, d: dt.divergence(_ev(s, d)).withColumn("second", dt.second_difference("divergence")).select("entity_id", "date", "second"),
    "ewma": lambda s, d: dt.acceleration(dt.divergence(_ev(s, d))).select("entity_id", "date", "acceleration"),
    "zscores": lambda s, d: dt.scored(_ev(s, d)).select("entity_id", "date", "divergence_z", "acceleration_z"),
    "alerts": lambda s, d: _plain(dt.alerts(_ev(s, d))),
    "asof_alerts": lambda s, d: _plain(dt.asof_alerts(_ev(s, d))),
    "save_alerts": save_alerts,
    "alert_counts": lambda s, d: sv.alert_counts(dt.asof_alerts(_ev(s, d))),
    "recent_alerts": recent_alerts,
    "null_scores": null_scores,
    "pattern_match": pattern_match,
    "changepoints": lambda s, d: dt.changepoints(dt.divergence(_ev(s, d)), 1),
    "changepoints5": lambda s, d: dt.changepoints(dt.divergence(_ev(s, d)), 5),
    "template_alerts": template_alerts,
    "asof_alerts_global": asof_alerts_global,
    "lead_lag1": lambda s, d: dt.lead_lag(_ev(s, d), ["hype"], "reality", 1),
    "lead_lag": lambda s, d: dt.lead_lag(_ev(s, d), ["hype"], "reality"),
}.items()}

ORACLE_SQL = {
    "sufficient": oracle("SELECT entity_id, count(*) AS n FROM ev GROUP BY entity_id HAVING count(*) >= 25"),
    "semi_sufficient": oracle("SELECT entity_id, date, hype, reality FROM ev_n WHERE all_n >= 25"),
    "robust_stats": oracle(f"SELECT entity_id, n, {r('hype_median', 'hype_iqr', 'reality_median', 'reality_iqr')} FROM rstats"),
    "divergence": oracle(f"SELECT entity_id, date, {r('hype', 'reality', 'divergence')} FROM diverg"),
    "acceleration": oracle(f"SELECT entity_id, date, {r('second')} FROM accel0"),
    "ewma": oracle(f"SELECT entity_id, date, {r('acceleration')} FROM accel"),
    "zscores": oracle(f"SELECT entity_id, date, {r('divergence_z', 'acceleration_z')} FROM zs"),
    "alerts": oracle(_ALERT_SQL + "alerted"),
    "asof_alerts": oracle(_ALERT_SQL + "asof_rows"),
    "save_alerts": oracle(_ALERT_SQL + "asof_rows WHERE timestamp >= TIMESTAMP '2024-01-16'"),
    "alert_counts": oracle("SELECT alert_level, count(*) AS n FROM asof_rows GROUP BY alert_level"),
    "recent_alerts": oracle(f"""
SELECT entity_name, timestamp, alert_level, {r_as({c: f'round(coalesce({c}, 0), 2)' for c in _ALERT})} FROM (
  SELECT *, CASE WHEN entity_id % 10 = 3 THEN 'Unknown' ELSE 'user-' || entity_id END AS entity_name, round(confidence, 2) AS c2 FROM asof_rows WHERE timestamp >= DATE '2024-01-23'
  QUALIFY row_number() OVER (PARTITION BY entity_name, timestamp ORDER BY c2 DESC, alert_level, entity_id) = 1)
ORDER BY timestamp DESC, c2 DESC, entity_name LIMIT 50"""),
    "null_scores": oracle("SELECT entity_id, count(*) FILTER (divergence_z IS NULL) AS bad_divergence_z, count(*) FILTER (acceleration IS NULL) AS bad_acceleration FROM zs JOIN accel USING (entity_id, date) GROUP BY entity_id HAVING bad_divergence_z + bad_acceleration > 0"),
    "changepoints": oracle(f"""
SELECT entity_id, CAST(1 AS INT) AS round, date, {r('gain')} FROM (
  SELECT entity_id, date, t * t / rn + (s - t) * (s - t) / (all_n - rn) - s * s / all_n AS gain FROM (
    SELECT entity_id, date, rn, all_n, sum(divergence) OVER (PARTITION BY entity_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS t, sum(divergence) OVER (PARTITION BY entity_id) AS s FROM diverg) WHERE rn < all_n
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(t * t / rn + (s - t) * (s - t) / (all_n - rn) - s * s / all_n, 9) DESC, date) = 1)"""),
    "pattern_match": oracle(f"SELECT entity_id, {r('pattern')} FROM warped"),
    "template_alerts": oracle(f"""
SELECT CAST(date AS TIMESTAMP) AS timestamp, entity_id, alert_level, {r_as({'divergence_score': 'dz', 'acceleration_score': 'az', 'pattern_score': 'p', 'confidence': '1 / (1 + exp(5 - (0.5 * abs(dz) + 0.3 * abs(az) + 0.2 * p)))'})} FROM (
  SELECT *, CASE WHEN dz - 1e-9 > 3.0 AND p > 0.8 THEN 'critical' WHEN dz - 1e-9 > 2.5 AND p > 0.6 THEN 'warning' WHEN dz - 1e-9 > 1.5 OR az - 1e-9 > 2.0 THEN 'watch' END AS alert_level FROM (
    SELECT date, entity_id, coalesce(divergence_z, 0) AS dz, coalesce(acceleration_z, 0) AS az, coalesce(pattern, 0) AS p FROM asof_scored LEFT JOIN warped_peaks USING (entity_id)))
WHERE alert_level IS NOT NULL"""),
    "asof_alerts_global": oracle(_ALERT_SQL + "asof_rows_all"),
    "changepoints5": oracle("SELECT * FROM (" + " UNION ALL ".join(f"SELECT entity_id, round, date, {r('gain')} FROM cp_best{k}" for k in range(5)) + ")"),
    "lead_lag1": oracle(f"SELECT entity_id, 'hype' AS indicator, {r_as({'score': 'CASE WHEN t > 0 THEN list_sum(list_transform(range(0, 2500), lambda k: exp((2 * k + 1) * ln(t) - t * t - lgamma(k + 1.5)))) ELSE 0 END'})} FROM lag1_root"),
}
