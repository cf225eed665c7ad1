"""Detection per entity: robust divergence, smoothed acceleration, z-scores, graded alerts; patterns, breaks, leads.

Input is (entity_id, date, hype, reality), one row per entity and date. Everything is computed for all entities at
once. As-of detection is a closed form: the location of a robust scaling cancels in the z-score of the last point, so
only the two interquartile ranges and second moments up to each row are needed. Short series get them by expanding
windows, long ones by chunks that carry sums and order statistics.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from . import chunks as ch

MIN_SAMPLES = 5
WATCH, WARNING, CRITICAL, ACCELERATED = 1.5, 2.5, 3.0, 2.0
PATTERN_WARNING, PATTERN_CRITICAL = 0.6, 0.8
DIVERGENCE_WEIGHT, ACCELERATION_WEIGHT, PATTERN_WEIGHT = 0.5, 0.3, 0.2
#: Smoothing of a span of 7, and a frame beyond which weights are below double precision.
DECAY, FRAME = 0.75, 128
#: A score on a threshold is not above it, in whatever order its sums were taken.
TOLERANCE = 1e-9
#: Up to so many points the templates are broadcast.
FEW_POINTS = 100_000
#: The entity that stands for all, see :func:`include_global`.
EVERYONE = -1
#: Variances below this are those of a constant.
FLAT = 1e-24


def sufficient(rows: DataFrame, n: int = MIN_SAMPLES, key: str = "entity_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def with_enough(rows: DataFrame, n: int = MIN_SAMPLES, key: str = "entity_id") -> DataFrame:
    return rows.join(sufficient(rows, n, key).select(key), key, "left_semi")


def _whole() -> Window:
    return Window.partitionBy("entity_id")


def _upto() -> Window:
    return Window.partitionBy("entity_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def _ordered() -> Window:
    return Window.partitionBy("entity_id").orderBy("date")


def robust_stats(rows: DataFrame) -> DataFrame:
    """Median and interquartile range of both series per entity, quartiles interpolated linearly."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    per = rows.groupBy("entity_id").agg(F.count("*").alias("n"), q("hype").alias("h"), q("reality").alias("r"))
    return per.select("entity_id", "n", F.col("h")[1].alias("hype_median"), (F.col("h")[2] - F.col("h")[0]).alias("hype_iqr"), F.col("r")[1].alias("reality_median"), (F.col("r")[2] - F.col("r")[0]).alias("reality_iqr"))


def divergence(rows: DataFrame) -> DataFrame:
    """``rows`` with the difference of both series, each scaled by median and interquartile range (0 counts as 1)."""
    filled = rows.na.fill(0.0, ["hype", "reality"])
    scale = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    met = filled.join(robust_stats(filled), "entity_id")
    value = (F.col("hype") - F.col("hype_median")) / scale("hype_iqr") - (F.col("reality") - F.col("reality_median")) / scale("reality_iqr")
    return met.select("entity_id", "date", "hype", "reality", value.alias("divergence"))


def second_difference(c: str, w: Window | None = None) -> Column:
    w = w or _ordered()
    return F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)


def smoothed(rows: DataFrame, of: dict[str, str], w: Window | None = None) -> DataFrame:
    """``rows`` with exponentially weighted means, named ``of``: column to name. Weights are adjusted; leading nulls are skipped.

    A weighted sum over the last 2 k values is the one over the last k plus that of k rows before, decayed: ``FRAME`` values
    take seven steps, all over one sort, and no row holds a list of them.
    """
    w = w or _ordered()
    parts = {f"{n}_{k}": v for c, n in of.items() for k, v in (("top", F.coalesce(c, F.lit(0.0))), ("all", F.col(c).isNotNull().cast("double")))}
    out, step = rows.withColumns(parts), 1
    while step < FRAME:
        out = out.withColumns({n: F.col(n) + DECAY**step * F.coalesce(F.lag(n, step).over(w), F.lit(0.0)) for n in parts})
        step *= 2
    return out.withColumns({n: F.when(F.col(c).isNotNull(), F.col(f"{n}_top") / F.col(f"{n}_all")) for c, n in of.items()}).drop(*parts)


def acceleration(rows: DataFrame, c: str = "divergence") -> DataFrame:
    """``rows`` with the second difference of ``c`` and its smoothed form."""
    return smoothed(rows.withColumn("second", second_difference(c)), {"second": "acceleration"})


def zscore(c: Column | str) -> Column:
    """By the population's deviation; null for a constant series."""
    x = F.col(c) if isinstance(c, str) else c
    sd = F.stddev_pop(x).over(_whole())
    return F.when(sd > math.sqrt(FLAT), (x - F.avg(x).over(_whole())) / sd)


def scored(rows: DataFrame) -> DataFrame:
    """(entity_id, date, divergence, acceleration, divergence_z, acceleration_z) of entities with enough rows."""
    accelerated = acceleration(divergence(with_enough(rows)))
    return accelerated.withColumns({"divergence_z": zscore("divergence"), "acceleration_z": zscore(F.coalesce("acceleration", F.lit(0.0)))})


def level(z: Column, a: Column, p: Column) -> Column:
    z, a = F.coalesce(z, F.lit(0.0)) - TOLERANCE, F.coalesce(a, F.lit(0.0)) - TOLERANCE
    return (
        F.when((z > CRITICAL) & (p > PATTERN_CRITICAL), "critical").when((z > WARNING) & (p > PATTERN_WARNING), "warning").when((z > WATCH) | (a > ACCELERATED), "watch")
    )


def confidence(z: Column, a: Column, p: Column) -> Column:
    return 1 / (1 + F.exp(5 - (DIVERGENCE_WEIGHT * F.abs(z) + ACCELERATION_WEIGHT * F.abs(a) + PATTERN_WEIGHT * p)))


def as_alerts(rows: DataFrame) -> DataFrame:
    """Alerts from (entity_id, date, divergence_z, acceleration_z, pattern)."""
    z, a, p = F.coalesce("divergence_z", F.lit(0.0)), F.coalesce("acceleration_z", F.lit(0.0)), F.col("pattern")
    factors = F.struct(z.alias("divergence"), a.alias("acceleration"), p.alias("pattern_similarity"))
    return rows.select(
        F.col("date").cast("timestamp").alias("timestamp"), "entity_id", level(z, a, p).alias("alert_level"), z.alias("divergence_score"), a.alias("acceleration_score"), p.alias("pattern_score"),
        confidence(z, a, p).alias("confidence"), factors.alias("contributing_factors"),
    ).where("alert_level is not null")


def _with_patterns(scores: DataFrame, patterns: DataFrame | None) -> DataFrame:
    if patterns is None:
        return scores.withColumn("pattern", F.lit(0.0))
    return scores.join(patterns, "entity_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit(0.0)))


def alerts(rows: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Alerts at each entity's last date, from its whole history. ``patterns``: (entity_id, pattern), 0 where absent."""
    last = scored(rows).groupBy("entity_id").agg(F.max_by(F.struct("date", "divergence_z", "acceleration_z"), "date").alias("r")).select("entity_id", "r.*")
    return as_alerts(_with_patterns(last, patterns))


def _combined_z(of: dict[str, Column], s_h: Column, s_r: Column) -> Column:
    """z-score of the last h / s_h - r / s_r, from the last values, means, variances and covariance of h and r."""
    top = (of["h"] - of["mean_h"]) / s_h - (of["r"] - of["mean_r"]) / s_r
    var = of["var_h"] / (s_h * s_h) + of["var_r"] / (s_r * s_r) - 2 * of["cov"] / (s_h * s_r)
    return F.when(var > 1e-18, top / F.sqrt(var))


_BEFORE = {"hype": "d2h", "reality": "d2r"}


def _smoothed_seconds(rows: DataFrame, w: Window) -> DataFrame:
    found = smoothed(rows.withColumns({n: second_difference(c, w) for c, n in _BEFORE.items()}), {"d2h": "a_h", "d2r": "a_r"}, w)
    return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("a_h", "a_r")}).drop(*_BEFORE.values())


def _asof_short(filled: DataFrame) -> DataFrame:
    """As-of scores by expanding windows; quartiles cost the square of a series' length."""
    upto = _upto()
    iqr = lambda c: (lambda q: F.when(q[1] - q[0] == 0, 1.0).otherwise(q[1] - q[0]))(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(upto))
    with_acc = _smoothed_seconds(filled.withColumns({"n": F.row_number().over(_ordered()).cast("long"), "s_h": iqr("hype"), "s_r": iqr("reality")}), _ordered())
    of = lambda h, r: {"h": F.col(h), "r": F.col(r), "mean_h": F.avg(h).over(upto), "mean_r": F.avg(r).over(upto), "var_h": F.var_pop(h).over(upto), "var_r": F.var_pop(r).over(upto), "cov": F.covar_pop(h, r).over(upto)}
    z = lambda h, r: _combined_z(of(h, r), F.col("s_h"), F.col("s_r"))
    return with_acc.select("entity_id", "date", "n", z("hype", "reality").alias("divergence_z"), z("a_h", "a_r").alias("acceleration_z"))


def prefix_select(values: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each length the value of a rank, from 0 on, among the first so many values.

    A tree over the bits of the values' ranks: each level counts the zeros before every place and deals the values on by
    their bit, and all questions walk down it together.
    """
    known, code = np.unique(values, return_inverse=True)
    low, high, left, found = np.zeros(len(lengths), np.int64), lengths.astype(np.int64), ranks.astype(np.int64), np.zeros(len(lengths), np.int64)
    for bit in reversed(range(max(1, int(len(known) - 1).bit_length()))):
        one = (code >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        below_low, below_high = zeros[low], zeros[high]
        count, total = below_high - below_low, zeros[-1]
        right = left >= count
        found |= right.astype(np.int64) << bit
        left = np.where(right, left - count, left)
        low, high = np.where(right, total + low - below_low, below_low), np.where(right, total + high - below_high, below_high)
        code = np.concatenate((code[one == 0], code[one == 1]))
    return known[found]


def expanding_quantile(own: np.ndarray, before: int, held: np.ndarray, below: int, p: float) -> np.ndarray:
    """The ``p``-quantile up to each of ``own``, after ``before`` values of which ``held`` are given and ``below`` lie under these."""
    n = before + np.arange(1, len(own) + 1)
    at = p * (n - 1)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, n - 1)
    line, lengths = np.concatenate((np.sort(held), own)), len(held) + np.arange(1, len(own) + 1)
    a, b = prefix_select(line, lengths, low - below), prefix_select(line, lengths, high - below)
    return np.where(a == b, a, (low + 1 - at) * a + (at - low) * b)


#: Series up to this length go by expanding windows; longer ones in chunks of so many rows.
SHORT, SIZE = 1_000, 20_000
_QUARTILES = (0.25, 0.75)


def _held_before(chunks: DataFrame, size: int) -> DataFrame:
    """``entity_id, chunk_no, series, quartile, v, below``: the values before each chunk that a quartile within it can take.

    Values are numbered in order of value and cut into blocks. How many of a block's values come before a chunk follows
    from counts by chunk and block; a quartile moves by less than a chunk's rows while the chunk passes, which leaves a few
    blocks of which the values are needed themselves.
    """
    e = ["entity_id", "series"]
    values = chunks.select("entity_id", F.col(ch.CHUNK).alias("at_chunk"), F.col(ch.ROW).alias("at_row"), F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in _BEFORE])))
    ranked = materialised(ch.chunked(values, e, ["v", "at_row"], size).withColumnRenamed(ch.CHUNK, "value_block"))
    cells = ranked.groupBy(*e, "value_block", F.col("at_chunk").alias(ch.CHUNK)).agg(F.count("*").alias("c"))
    lengths = chunks.groupBy("entity_id", ch.CHUNK).agg(F.count("*").alias("m"))
    grid = ranked.select(*e, "value_block").distinct().join(lengths, "entity_id").join(cells, [*e, "value_block", ch.CHUNK], "left")  # the square of the number of chunks
    earlier = lambda by, order: Window.partitionBy(*e, by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    grid = grid.withColumn("held", F.coalesce(F.sum("c").over(earlier("value_block", ch.CHUNK)), none)).withColumn("below", F.coalesce(F.sum("held").over(earlier(ch.CHUNK, "value_block")), none))
    before = F.col(ch.CHUNK) * size
    wanted = [F.struct(F.lit(p).alias("quartile"), (F.floor(before * p) - F.col("m") - 2).alias("from"), (F.floor((before + F.col("m")) * p) + 2).alias("to")) for p in _QUARTILES]
    need = grid.where("held > 0").select(*e, ch.CHUNK, "value_block", "held", "below", F.inline(F.array(*wanted))).where((F.col("below") <= F.col("to")) & (F.col("below") + F.col("held") > F.col("from")))
    return need.join(ranked, [*e, "value_block"]).where(F.col("at_chunk") < F.col(ch.CHUNK)).select("entity_id", ch.CHUNK, "series", "quartile", "v", "below")


def _spreads(size: int):
    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(ch.ROW)
        out, before = {"entity_id": own["entity_id"], ch.ROW: own[ch.ROW]}, int(own[ch.CHUNK].iloc[0]) * size if len(own) else 0
        for series, name in (("hype", "s_h"), ("reality", "s_r")):
            ends = []
            for p in _QUARTILES:
                some = held[(held["series"] == series) & (held["quartile"] == p)]
                ends.append(expanding_quantile(own[series].to_numpy(float), before, some["v"].to_numpy(float), int(some["below"].min()) if len(some) else 0, p))
            spread = ends[1] - ends[0]
            out[name] = np.where(spread == 0, 1.0, spread)
        return pd.DataFrame(out)

    return run


def _asof_long(filled: DataFrame, size: int) -> DataFrame:
    """As-of scores by chunks of ``size`` rows, which carry sums and order statistics; no task holds a longer series."""
    e = ["entity_id"]
    reach = FRAME + 2
    chunks = materialised(ch.chunked(filled, e, ["date"], size))
    smooth = _smoothed_seconds(ch.with_halo(chunks, size, reach), ch.within(e)).where(ch.OWN).drop(ch.OWN)
    pivots = chunks.where(F.col(ch.ROW) == 1).select(F.col("entity_id").alias("of_entity"), F.col("hype").alias("p_h"), F.col("reality").alias("p_r"))
    moved = materialised(smooth.join(pivots, F.col("entity_id") == F.col("of_entity")).drop("of_entity"))
    pairs = {"d": (F.col("hype") - F.col("p_h"), F.col("reality") - F.col("p_r")), "a": (F.col("a_h"), F.col("a_r"))}
    sums = {f"sum_{k}_{n}": v for k, (h, r) in pairs.items() for n, v in (("h", h), ("r", r), ("hh", h * h), ("rr", r * r), ("hr", h * r))}
    run = ch.running(moved, e, sums)
    held = _held_before(chunks, size).withColumnsRenamed({"entity_id": "of_entity", ch.CHUNK: "of_chunk"})
    spread = chunks.groupBy("entity_id", ch.CHUNK).cogroup(held.groupBy("of_entity", "of_chunk")).applyInPandas(_spreads(size), f"entity_id long, {ch.ROW} long, s_h double, s_r double")
    met = run.join(spread, ["entity_id", ch.ROW])
    n = F.col(ch.ROW)

    def z(k: str) -> Column:
        mean = {x: F.col(f"sum_{k}_{x}") / n for x in ("h", "r", "hh", "rr", "hr")}
        h, r = pairs[k]
        of = {"h": h, "r": r, "mean_h": mean["h"], "mean_r": mean["r"], "var_h": mean["hh"] - mean["h"] * mean["h"], "var_r": mean["rr"] - mean["r"] * mean["r"], "cov": mean["hr"] - mean["h"] * mean["r"]}
        return _combined_z(of, F.col("s_h"), F.col("s_r"))

    return met.select("entity_id", "date", n.alias("n"), z("d").alias("divergence_z"), z("a").alias("acceleration_z"))


def asof_scores(rows: DataFrame, short: int = SHORT, size: int = SIZE) -> DataFrame:
    """Both z-scores at each row from the rows up to it, from the entity's ``MIN_SAMPLES``-th row on.

    Series of more than ``short`` rows are cut into chunks of ``size`` rows; the scores are the same.
    """
    filled = rows.na.fill(0.0, ["hype", "reality"])
    lengths = filled.groupBy("entity_id").agg(F.count("*").alias("rows_of"))
    long = lengths.where(F.col("rows_of") > short).select("entity_id")
    if long.isEmpty():
        found = _asof_short(filled)
    else:
        found = _asof_short(filled.join(long, "entity_id", "left_anti")).unionByName(_asof_long(filled.join(long, "entity_id", "left_semi"), size))
    return found.where(F.col("n") >= MIN_SAMPLES)


def include_global(rows: DataFrame, overall: DataFrame, key: int = EVERYONE) -> DataFrame:
    """``rows`` and the series of all entities together, (date, hype, reality), as an entity of its own."""
    return rows.unionByName(overall.select(F.lit(key).cast("long").alias("entity_id"), "date", "hype", "reality"))


def asof_alerts(rows: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Alerts for every date from the rows up to it. An entity without a row on a date is taken at its last row before.

    ``patterns``: (entity_id, pattern) for all dates, 0 where absent.
    """
    found = asof_scores(rows).withColumn("until", F.lead("date").over(_ordered()))
    spine = rows.select(F.col("date").alias("day")).distinct()
    last = spine.agg(F.date_add(F.max("day"), 1).alias("end"))
    spans = found.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce("until", "end"))  # one row
    days = spans.withColumn("day", F.explode(F.sequence("date", F.date_sub("until", 1))))
    carried = days.join(spine, "day", "left_semi").select("entity_id", F.col("day").alias("date"), "divergence_z", "acceleration_z")
    return as_alerts(_with_patterns(carried, patterns))


def save_alerts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows to append: distinct, without NaN, not there yet by (timestamp, entity_id, alert_level)."""
    doubles = [c for c, t in new.dtypes if t == "double"]
    clean = new.withColumns({c: F.when(F.isnan(c), 0.0).otherwise(F.col(c)) for c in doubles}).distinct()
    return clean.join(existing.select("timestamp", "entity_id", "alert_level").distinct(), ["timestamp", "entity_id", "alert_level"], "left_anti")


def _normal(x: np.ndarray) -> np.ndarray:
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / sd if sd > 0 else np.zeros_like(x)


def warped_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Root of the least summed squared cost over all warpings; one numpy step per diagonal of the table, in linear memory."""
    n, m = len(a), len(b)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # the two diagonals before, by row + 1
    before[0] = 0.0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        now = np.full(n + 1, np.inf)
        now[i + 1] = (a[i] - b[d - i]) ** 2 + np.minimum(np.minimum(last[i], last[i + 1]), before[i])
        before, last = last, now
    return float(np.sqrt(last[n]))


def bounds_below(own: np.ndarray, shapes: list[np.ndarray]) -> np.ndarray:
    """For each shape a number that no warping of it onto ``own`` costs less than, squared.

    First meets first and last meets last; and every point meets some point of the other series, so it costs at least what
    it lies outside of the other's range.
    """
    low, high, out = own.min(), own.max(), np.zeros(len(shapes))
    for i, t in enumerate(shapes):
        ends = (own[0] - t[0]) ** 2 + ((own[-1] - t[-1]) ** 2 if max(len(own), len(t)) > 1 else 0.0)
        outside = [np.maximum(np.maximum(x - b, a - x), 0.0) for x, a, b in ((own, t.min(), t.max()), (t, low, high))]
        out[i] = max(ends, *[(o**2).sum() for o in outside])
    return out


def nearest_shape(own: np.ndarray, shapes: list[np.ndarray]) -> tuple[float, int, int]:
    """(distance, index) of the nearest shape, and how many were compared; shapes go by their bounds, until these are too large."""
    bounds = bounds_below(own, shapes)
    best, at, compared = np.inf, -1, 0
    for i in np.argsort(bounds, kind="stable").tolist():
        if bounds[i] > best * best * (1 + TOLERANCE):
            break
        compared += 1
        if (d := warped_distance(own, shapes[i])) < best:
            best, at = d, i
    return best, at, compared


def _packs(templates: DataFrame) -> list[list[tuple]]:
    """The templates in packs of up to ``FEW_POINTS`` points, or one template; each pack is sent to the tasks once."""
    sizes = templates.groupBy("template").agg(F.count("*").alias("n")).orderBy("template").collect()  # a row per template
    packs, points = [], FEW_POINTS + 1
    for r in sizes:
        if points + r["n"] > FEW_POINTS:
            packs.append([])
            points = 0
        packs[-1].append(r["template"])
        points += r["n"]
    return packs


def pattern_search(series: DataFrame, templates: DataFrame) -> DataFrame:
    """``entity_id, pattern, template, compared, pruned``: each entity's nearest template, as 1 / (1 + distance).

    ``series``: (entity_id, date, divergence); ``templates``: (template, pos, value). Templates go to the tasks as arrays, in
    packs of a bounded size, so no pair of a series and a template is shuffled; of these pairs only those are warped whose
    lower bound does not rule them out, and ``pruned`` counts the others.
    """
    lines = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("pos"), F.col("divergence").alias("value"))))
    own = series.groupBy("entity_id").agg(lines.alias("own")).select("entity_id", F.col("own.value").alias("own"))
    found = None
    for names in _packs(templates):
        lines_of = templates.where(F.col("template").isin(names)).groupBy("template").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("t")).collect()  # up to FEW_POINTS points
        shapes = {r["template"]: _normal(np.array([p["value"] for p in r["t"]], float)) for r in sorted(lines_of, key=lambda r: str(r["template"]))}

        def search(frames, shapes=shapes):
            for frame in frames:
                out = []
                for entity, values in zip(frame["entity_id"], frame["own"]):
                    distance, at, compared = nearest_shape(_normal(np.asarray(values, float)), list(shapes.values()))
                    out.append((entity, distance, str(list(shapes)[at]), compared, len(shapes) - compared))
                yield pd.DataFrame(out, columns=["entity_id", "distance", "template", "compared", "pruned"])

        one = own.mapInPandas(search, "entity_id long, distance double, template string, compared long, pruned long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return series.select(F.col("entity_id").cast("long").alias("entity_id"), F.lit(0.0).alias("pattern"), F.lit("").alias("template"), *[F.lit(0).cast("long").alias(c) for c in ("compared", "pruned")]).limit(0)
    best = F.min(F.struct("distance", "template")).alias("best")
    per = found.groupBy("entity_id").agg(best, F.sum("compared").alias("compared"), F.sum("pruned").alias("pruned"))
    return per.select("entity_id", (1 / (1 + F.col("best.distance"))).alias("pattern"), "best.template", "compared", "pruned")


def pattern_match(series: DataFrame, templates: DataFrame) -> DataFrame:
    """(entity_id, pattern): 1 / (1 + distance to the nearest template), see :func:`pattern_search`."""
    return pattern_search(series, templates).select("entity_id", "pattern")


def prefix_moments(series: DataFrame, size: int | None = None) -> DataFrame:
    """``entity_id, date, k, t``: how many values an entity has up to each date, and their sum. ``size``: the rows of a chunk."""
    rows = series.select("entity_id", "date", F.col("divergence").alias("x"))
    if size is None:
        w = _ordered()
        return rows.select("entity_id", "date", F.row_number().over(w).cast("long").alias("k"), F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("t"))
    return ch.running(ch.chunked(rows, ["entity_id"], ["date"], size), ["entity_id"], {"t": F.col("x")}).select("entity_id", "date", F.col(ch.ROW).alias("k"), "t")


def _best_splits(prefix: DataFrame, segments: DataFrame) -> DataFrame:
    """``segments`` (entity_id, low, high, t_low, t_high) that can be split, with their best split ``k, t, date, gain``.

    A segment holds the values after ``low`` up to ``high``; what its split gains follows from prefix moments alone.
    """
    of = segments.select(F.col("entity_id").alias("of_entity"), "low", "high", "t_low", "t_high")
    met = prefix.join(of, (F.col("entity_id") == F.col("of_entity")) & (F.col("k") > F.col("low")) & (F.col("k") < F.col("high")))
    part = lambda s, n: s * s / n
    gain = part(F.col("t") - F.col("t_low"), F.col("k") - F.col("low")) + part(F.col("t_high") - F.col("t"), F.col("high") - F.col("k")) - part(F.col("t_high") - F.col("t_low"), F.col("high") - F.col("low"))
    best = F.max_by(F.struct("k", "t", "date", "gain"), F.struct(F.round("gain", 9), -F.unix_date("date")))
    per = met.withColumn("gain", gain).groupBy("entity_id", "low", "high", "t_low", "t_high").agg(best.alias("b"))
    return per.select("entity_id", "low", "high", "t_low", "t_high", "b.*")


def changepoints(series: DataFrame, n: int = 5, size: int | None = None) -> DataFrame:
    """(entity_id, round, date, gain): binary segmentation by squared error, one best split per entity and round.

    Prefix moments are written once. Each entity has a queue of segments with their best splits; a round takes the best of
    it and scores the two new segments only. Rounds are written, so the plan of each is the same, whatever their number.
    """
    prefix = materialised(prefix_moments(series, size))
    ends = prefix.groupBy("entity_id").agg(F.max("k").alias("high"), F.max_by("t", "k").alias("t_high"))
    queue = materialised(_best_splits(prefix, ends.select("entity_id", F.lit(0).cast("long").alias("low"), "high", F.lit(0.0).alias("t_low"), "t_high")))
    found = []
    for number in range(1, n + 1):
        whole = F.struct("low", "high", "t_low", "t_high", "k", "t", "date", "gain")
        top = queue.groupBy("entity_id").agg(F.max_by(whole, F.struct(F.round("gain", 9), -F.unix_date("date"))).alias("b")).select("entity_id", "b.*")
        top = materialised(top)
        found.append(top.select("entity_id", F.lit(number).alias("round"), "date", "gain"))
        if number == n:
            break
        halves = F.array(F.struct("low", F.col("k").alias("high"), "t_low", F.col("t").alias("t_high")), F.struct(F.col("k").alias("low"), "high", F.col("t").alias("t_low"), "t_high"))
        rest = queue.join(top.select("entity_id", "low"), ["entity_id", "low"], "left_anti")
        queue = materialised(rest.unionByName(_best_splits(prefix, top.select("entity_id", F.inline(halves)))))
    return reduce(DataFrame.unionByName, found)


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square with an integer number of degrees of freedom."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return min(total, 1.0)
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return min(total, 1.0)


def lead_lag(rows: DataFrame, indicators: list[str], target: str, max_lag: int = 5) -> DataFrame:
    """(entity_id, indicator, score): 1 minus the least p of a chi-square test that lags of the indicator help.

    Lagged columns give cross-product sums by entity, indicator and lag; only those small matrices reach Python.
    """
    each = [F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("v")) for i in indicators]
    long = rows.select("entity_id", "date", F.col(target).cast("double").alias("y"), F.explode(F.array(*each)).alias("i")).select("entity_id", "date", "y", "i.*")
    w = Window.partitionBy("entity_id", "indicator").orderBy("date")
    lagged = long.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("y", "v") for k in range(1, max_lag + 1)}).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    names = [f"y{k}" for k in range(1, max_lag + 1)] + [f"v{k}" for k in range(1, max_lag + 1)]
    used = [F.when((F.lit(int(n[1:])) <= F.col("lag")), F.col(n)).otherwise(0.0).alias(n) for n in names]
    complete = lagged.where(F.array_compact(F.array(*[F.when(F.lit(k) <= F.col("lag"), F.when(F.col(f"y{k}").isNull(), 1)) for k in range(1, max_lag + 1)])) == F.array().cast("array<int>"))
    design = complete.select("entity_id", "indicator", "lag", "y", F.array(F.lit(1.0), *used).alias("x"))
    size = 2 * max_lag + 1
    cells = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(i, size)] + [F.sum(F.col("x")[i] * F.col("y")).alias(f"b{i}") for i in range(size)]
    sums = design.groupBy("entity_id", "indicator", "lag").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *cells)

    def test(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                lag, n = int(row["lag"]), row["n"]
                gram = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
                right = np.array([row[f"b{i}"] for i in range(size)])

                def rss(cols: list[int]) -> float:
                    beta = np.linalg.lstsq(gram[np.ix_(cols, cols)], right[cols], rcond=None)[0]
                    return max(row["yy"] - right[cols] @ beta, 0.0)

                own = list(range(lag + 1))
                small, full = rss(own), rss(own + [max_lag + k for k in range(1, lag + 1)])
                if n > 2 * lag + 1:
                    stat = n * (small - full) / full if full > 1e-9 else (0.0 if small <= 1e-9 else math.inf)
                    out.append((row["entity_id"], row["indicator"], chi2_tail(stat, lag)))
            yield pd.DataFrame(out, columns=["entity_id", "indicator", "p"])

    tested = sums.mapInPandas(test, "entity_id long, indicator string, p double")
    return tested.groupBy("entity_id", "indicator").agg((1 - F.min("p")).alias("score"))
