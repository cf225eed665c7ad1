"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, both summed over all labelled training rows in one pass. A class covariance
is shrunk towards the pooled one and then towards a multiple of the identity, and its Cholesky factor is computed
once and sent to the tasks. A document's raw score is the difference of the two Mahalanobis log-densities plus the log
odds of the classes; a logistic curve, fitted to counts of raw scores by class, turns it into a probability.

Rows whose crc32 of the decimal ``doc_id``, modulo 4, is 2 are held out: their labels are never read. Scores use the
text alone.

Edge cases: a null text counts as empty, and empty texts are scored as any other; a label without a document, or a
null label, trains nothing; a ``doc_id`` with several labels trains with each; if one class is missing every score
is 0.5; repeated rows are scored alike; an empty table gives an empty result; a null ``doc_id`` is not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, cut

#: Shares of the pooled covariance and of the scaled identity in a class covariance.
POOLED, IDENTITY = 0.3, 0.02
#: A document counts as good from this score on.
THRESHOLD = 0.7
#: Raw scores are counted in this many steps of this width for the calibration.
STEPS, WIDTH = 400, 0.25

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 other ASCII, 7 beyond ASCII
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\x0b\x0c\r", 4), (".,;:?'-", 5)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[:128][_CLASS[:128] == 0] = 6
_CLASS[128:] = 7

FEATURES = (
    "chars", "words", "word_length", "lower", "upper", "digit", "mark", "symbol", "beyond", "short_words", "odd_words", "all_upper", "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines", "line_ends", "entropy",
)


def _share(part: float, whole: float) -> float:
    """A log share that is finite for 0 and for an empty whole."""
    return float(np.log((part + 0.5) / (whole + 1.0)))


def features(text: str | None) -> list[float]:
    """Transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[codes], minlength=8) if n else np.zeros(8)
    letters = np.bincount(codes, minlength=256) if n else np.zeros(256)
    p = letters[letters > 0] / max(n, 1)
    words = raw.split()
    w = len(words)
    often = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    odd = sum(c for x, c in often.items() if not x.strip(b".,;:?!'\"()-").isalnum() and x.isascii())
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(lengths.mean() if w else 0)), _share(kinds[1], n), _share(kinds[2], n), _share(kinds[3], n), _share(kinds[5], n), _share(kinds[6], n), _share(kinds[7], n),
        _share(int((lengths <= 3).sum()), w), _share(odd, w), _share(sum(c for x, c in often.items() if len(x) > 1 and x.isupper()), w), _share(len(often), w), _share(max(often.values(), default=0), w), _share(pairs, w),
        float(np.log1p(n / max(len(lines), 1))), _share(len(set(lines)), len(lines)), _share(ends, len(lines)), float(-(p * np.log(p)).sum()) if n else 0.0,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the vector of statistics."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "x": [features(t) for t in frame["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, x array<double>")


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for label, part in frame.groupby("quality"):
            x = np.vstack(part["x"].to_list())
            at = sums.setdefault(int(label), np.zeros(1 + d + d * d))
            at += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
    for label, s in sums.items():
        yield pd.DataFrame({"quality": label, "i": np.arange(len(s)), "v": s})


@dataclass(frozen=True)
class Discriminant:
    """What scoring needs: per class the mean, the inverse Cholesky factor and the log-density's constant."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def of(cls, sums: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
        d = len(FEATURES)
        if any(k not in sums or sums[k][0] < 2 for k in (0, 1)):
            return None
        count = np.array([sums[k][0] for k in (0, 1)])
        means = np.array([sums[k][1 : 1 + d] / sums[k][0] for k in (0, 1)])
        own = [sums[k][1 + d :].reshape(d, d) / sums[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
        shared = (count[0] * own[0] + count[1] * own[1]) / count.sum()
        scale = np.diag(np.maximum(np.diag(shared), 1e-6))
        factors, constants = [], []
        for k in (0, 1):
            cov = (1 - pooled) * own[k] + pooled * shared
            cov = (1 - identity) * cov + identity * scale
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            constants.append(np.log(count[k] / count.sum()) - np.log(np.diag(low)).sum())
        return cls(means, np.array(factors), np.array(constants))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference of the classes, good minus bad."""
        away = [((x - self.means[k]) @ self.factors[k].T) for k in (0, 1)]
        return (self.constants[1] - 0.5 * (away[1] ** 2).sum(axis=1)) - (self.constants[0] - 0.5 * (away[0] ** 2).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.raw(x)) + self.offset, -30, 30)))

    def calibrated(self, steps: np.ndarray, good: np.ndarray, all_rows: np.ndarray) -> Discriminant:
        """Slope and offset of the logistic curve through counted raw scores, by Newton's method with a weak prior."""
        z, beta = (steps - STEPS / 2 + 0.5) * WIDTH, np.array([1.0, 0.0])
        design = np.stack((z, np.ones_like(z)), axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            step = np.linalg.solve((design.T * (all_rows * p * (1 - p))) @ design + np.eye(2) * 1e-3, design.T @ (good - all_rows * p) - 1e-3 * (beta - [1.0, 0.0]))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        return Discriminant(self.means, self.factors, self.constants, float(max(beta[0], 1e-3)), float(beta[1]))


def squash(raw: np.ndarray) -> np.ndarray:
    """Raw scores with the far tails drawn in; monotone."""
    return np.arcsinh(raw / 4) * 4


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learned from."""
    return labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))


def train(rows: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on all labelled rows that are not held out. ``rows`` is (doc_id, x)."""
    labelled = cut(rows.join(known_labels(labels), "doc_id").select("quality", "x"))
    d = len(FEATURES)
    sums: dict[int, np.ndarray] = {}
    for r in labelled.mapInPandas(_moments, "quality int, i int, v double").groupBy("quality", "i").agg(F.sum("v").alias("v")).collect():  # 2 (1 + d + d d) rows
        sums.setdefault(r.quality, np.zeros(1 + d + d * d))[r.i] = r.v
    model = Discriminant.of(sums)
    if model is None:
        return None

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.clip(squash(model.raw(np.vstack(frame["x"].to_list()))) / WIDTH + STEPS / 2, 0, STEPS - 1).astype(int)
            yield pd.DataFrame({"at": at, "good": frame["quality"], "rows": 1}).groupby("at", as_index=False)[["good", "rows"]].sum()

    counts = labelled.mapInPandas(steps, "at long, good long, rows long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("rows").alias("rows")).orderBy("at").collect()  # STEPS rows at most
    at, good, total = (np.array([r[i] for r in counts], float) for i in range(3))
    return model.calibrated(at, good, total)


def scored(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = np.full(len(frame), 0.5) if model is None or not len(frame) else model.score(np.vstack(frame["x"].to_list()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": s})

    return rows.mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    rows = cut(with_features(docs))
    told = scored(rows, train(rows, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept; texts are never shuffled.

    The statistics for training are those of labelled documents; the ids are sent to the scan of the texts if they are
    few by count. If a class is missing, every score is 0.5 as in :func:`classify`, and all documents are rejected. Null
    and empty texts are scored as any other; repeated rows are judged alike; an empty table gives an empty result.
    """
    ids = known_labels(labels).select("doc_id").where("doc_id is not null").distinct()
    few = ids.count() <= FEW_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(cut(with_features(texts.join(F.broadcast(ids), "doc_id", "left_semi") if few else texts)), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(text), 0.5))
        return pd.Series(model.score(np.array([features(t) for t in text]).reshape(len(text), len(FEATURES))))

    return docs.select(F.struct("*").alias("doc")).withColumn("score", score(F.col("doc.text"))).where(F.col("score") >= THRESHOLD).select("doc.*")
