"""Quality classifier: Bradley-Terry ranking of documents, learned from preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import remainder, small, table, texts

_MARKS = b".,;:!?|$%&*#\"'()[]{}<>=+-_/\\@"
FEATURES = 16 + len(_MARKS)
CUT = 0.3


def features(text: bytes) -> list[float]:
    """Shares and shapes of a text, all finite; nothing but the text is looked at."""
    n = max(1, len(text))
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = Counter(words)
    line_counts = Counter(lines)
    ends = [w[-1] in b".!?" for w in words]
    lower, upper = int(hist[97:123].sum()), int(hist[65:91].sum())
    letters = max(1, lower + upper)
    marked = sum(w[-1] in _MARKS and w[-1] not in b".,;:!?" for w in words)
    out = [
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.sum() / m,
        float((lengths <= 3).sum()) / m,
        float((lengths >= 12).sum()) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        np.log1p(len(lines)),
        len(line_counts) / k,
        max(line_counts.values()) / k,
        sum(ends) / m,
        marked / m,
        upper / letters,
        float(hist[48:58].sum()) / n,
        float(hist[128:].sum()) / n,
        float(hist[10]) / n,
    ]
    return [float(x) for x in out] + [float(np.sqrt(hist[c] / n)) for c in _MARKS]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the standardised features, their squares after them
    cut: float  # the raw score at the quantile that the labels give
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _basis(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, and CUT at the quantile's raw score: at least CUT is above the quantile."""
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([z, z * z])


def rank(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, pairs: int = 100_000, penalty: float = 1e-3, seed: int = 42) -> Ranking:
    """Learns from features x and labels y (1 is preferred to 0): pairs of one row of each label, drawn by seed;
    logistic loss on the difference of their features, by Newton's steps. The cut is the raw scores' quantile
    at the share of label 0, and the slope fits the labels best, both with rows counted by their weights (how many
    rows each stands for; one if not given). With one label only, or none, all
    documents score alike: the share of label 1, or a half."""
    weights = np.ones(len(y)) if weights is None else weights
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        width = x.shape[1] if x.size else FEATURES
        shift = np.log(CUT / (1 - CUT)) - np.log(p / (1 - p))
        return Ranking(np.zeros(width), np.ones(width), np.zeros(2 * width), float(shift), 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _basis(x, mean, scale)
    draw = np.random.default_rng(seed)
    better = z[draw.choice(np.flatnonzero(y == 1), pairs)]
    d = better - z[draw.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = d.T @ p / pairs - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    upto = np.cumsum(weights[order])
    places = (upto - weights[order]) / max(1e-12, upto[-1] - weights[order][-1])
    cut = float(np.interp(weights[y == 0].sum() / weights.sum(), places, raw[order]))
    shift, best = np.log(CUT / (1 - CUT)), (np.inf, 1.0)
    for slope in np.geomspace(0.05, 20, 60):
        t = np.clip(slope * (raw - cut) + shift, -500, 500)
        best = min(best, (float(np.average(np.logaddexp(0, t) - y * t, weights=weights)), float(slope)))
    return Ranking(mean, scale, w, cut, best[1])


def _featured(rows: DataFrame) -> DataFrame:
    """rows (first column text as binary, others as they are), with x, the features, in place of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *batch.schema.names[1:]])

    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"x array<double>, {others}")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> Ranking:
    """A ranking learned from the rows of labels (doc_id, quality 0 or 1; others are ignored, and several
    rows of an id count as their greatest) that docs has texts for: from about `sample` of these rows, those
    of the lowest hash of the id, at most half of them of one label if there are enough. The bound is on
    what is learned from; sampled rows are weighted by their label's sampling rate, so that the share of each label,
    by which the cut is set, and the slope are as of all of them."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rates = {y: min(1.0, sample / n * max(0.5, n / sum(counts.values()))) for y, n in counts.items()}
    share = F.lit(0.0)
    for y, rate in rates.items():
        share = F.when(F.col("y") == y, rate).otherwise(share)
    chance = F.pmod(F.xxhash64(F.lit("quality"), F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = marks.filter(chance < share)
    rows = texts(docs).join(F.broadcast(some), F.col("doc_id") == F.col("id"))
    found = _featured(rows.select(F.col("text").cast("binary").alias("text"), "y", "id")).toPandas().sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), FEATURES)
    y = found["y"].to_numpy(dtype=int)
    return rank(x, y, np.array([1 / rates[k] for k in y.tolist()]), **how)


def judge(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, score, predicted (1 if the score is at least CUT, else 0), one row per row of docs. Null texts are
    empty, and empty ones are scored like others. Null ids and repeated rows are scored like others, texts that are the same alike; an
    empty table gives no rows; other columns are ignored. Nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, FEATURES)
            score = held.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    return judge(docs, ranking).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
