"""Quality classifier: naive Bayes features in a support vector machine.

A text becomes the set of hashed n-grams that it has (indicators): windows of three and four bytes, with case and
punctuation kept and digits alike; and windows of eight character classes (small letter, capital, digit, each other
byte for itself). Each is scaled by the log ratio of its smoothed frequencies in the two classes; a text's vector is
scaled to length 1; a linear model with hinge loss is fitted by dual coordinate descent, each dual variable held between 0 and
its row's cost. The margin becomes a probability by a logistic curve fitted on margins of rows that the model which gives them has not seen (FOLDS).

Fitting uses a bounded sample (TRAIN_DOCS labelled rows, shared evenly by the classes); weights undo that share when
the probability is fitted. Scoring is a sum over a table of bounded size.

Defined results: a null or empty text has no windows and gets the score of the bias alone; ties and repeated rows
score alike; with labels of one class only, every score is that class's; without labels every score is 0.5; an empty
table gives an empty table; columns named like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .langid import held_out, learnt

#: Buckets of byte windows, and of both kinds: class windows come behind them.
BYTES, BUCKETS = 1 << 16, 1 << 17
#: Bound on the labelled rows the model is fitted on.
TRAIN_DOCS = 4000
#: Added to every bucket's count of a class.
SMOOTH = 0.3
#: Parts of the sample, each scored by a model of the others for the probability's curve.
FOLDS = 5
#: A score from which a text counts as good.
GOOD = 0.7
CHUNK = 1 << 20
_FOLD = bytes(48 if 48 <= c <= 57 else c for c in range(256))
# Classes: small letters and parts of letters beyond ASCII are a, capitals A, digits 0.
_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
WIDE = 8


def indicators(text: str | None) -> np.ndarray:
    """Buckets that have a window of the text, ascending."""
    raw = b" " + (text or "").encode() + b" "
    seen = np.zeros(BUCKETS, bool)
    if len(raw) == 2:
        return np.zeros(0, np.int64)
    data = raw.translate(_FOLD) + b"\0\0"
    for lo in range(0, len(data) - 3, CHUNK):
        n = min(CHUNK, len(data) - 3 - lo)
        for k in range(4):
            w = np.frombuffer(data, "<u4", max(0, (n - k + 3) // 4), lo + k)
            seen[w * np.uint32(2654435761) >> np.uint32(16)] = True
            seen[(w & np.uint32(0xFFFFFF)) * np.uint32(2246822519) >> np.uint32(16)] = True
    data = raw.translate(_CLASS) + b"\0" * WIDE
    for lo in range(0, len(raw), CHUNK):
        n = min(CHUNK, len(raw) - lo)
        for k in range(min(n, WIDE)):
            w = np.frombuffer(data, "<u8", (n - k + WIDE - 1) // WIDE, lo + k)
            seen[(w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)) + np.uint64(BYTES)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        f = self.ratio[at]
        size = float(np.sqrt(f @ f))
        return (float(f @ self.weight[at]) / size if size else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _flat(p: float) -> Model:
    none = np.zeros(BUCKETS)
    return Model(none, none, 0.0, 0.0, float(np.log(p / (1 - p))))


def hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half the squared weights plus cost times the hinge loss, by dual coordinate
    descent; the bias is the weight of a constant feature."""
    # A row's values are its ratios by its length; only the length is kept.
    scale = np.array([1 / max(1e-12, float(np.sqrt(ratio[at] @ ratio[at]))) for at in rows])
    norm = np.array([float(ratio[at] @ ratio[at]) * s * s + 1.0 for at, s in zip(rows, scale)])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            v = ratio[at] * scale[i]
            g = y[i] * (float(v @ w[at]) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[at] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve of margins, by Newton's method with a small ridge."""
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    weight = weight / weight.sum() * len(weight)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (slope, shift), -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * np.array([slope, shift])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 0.0)), float(shift)


def train(texts: list[str | None], labels: list[int], share: dict[int, float] | None = None, cost: float = 1.0) -> Model:
    return train_on([indicators(t) for t in texts], labels, share, cost)


def train_on(rows: list[np.ndarray], labels: list[int], share: dict[int, float] | None = None, cost: float = 1.0) -> Model:
    """rows: indicators of texts; labels: 1 good, 0 bad; share: the part of each class that was sampled."""
    if not labels or len(set(labels)) == 1:
        return _flat(0.5 if not labels else 0.999 if labels[0] else 0.001)
    y = np.where(np.array(labels) > 0, 1, -1)
    model, margin = _weights(rows, y, cost), np.zeros(len(y))
    # Margins of rows that a model has not seen, where each class has rows for all folds; else the model's own.
    if min((y > 0).sum(), (y < 0).sum()) >= 2 * FOLDS:
        fold = np.zeros(len(y), np.int64)
        for s in (1, -1):
            fold[y == s] = np.arange((y == s).sum()) % FOLDS
        for k in range(FOLDS):
            part = _weights([r for r, f in zip(rows, fold) if f != k], y[fold != k], cost)
            for i in np.flatnonzero(fold == k):
                margin[i] = part.margin(rows[i])
    else:
        margin[:] = [model.margin(r) for r in rows]
    back = np.array([1 / (share or {}).get(int(v > 0), 1.0) for v in labels])
    model.slope, model.shift = logistic(margin, y, back)
    return model


def _weights(rows: list[np.ndarray], y: np.ndarray, cost: float) -> Model:
    """Log-count ratios and the linear model on them, the classes' costs balanced."""
    count = {s: np.full(BUCKETS, SMOOTH) for s in (1, -1)}
    for r, v in zip(rows, y):
        count[int(v)][r] += 1  # a row has a bucket once
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    balance = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    return Model(ratio, *hinge(rows, y, ratio, cost * balance), 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Draw labelled ids first; only they, a bounded number, are broadcast to the documents."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    n = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    if not n:
        return _flat(0.5)
    share = {k: min(1.0, most / len(n) / v) for k, v in n.items()}
    table = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(v))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    ids = usable.where(drawn < F.element_at(table, F.col("quality"))).limit(2 * most)
    rows = learnt(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "quality", _written, 4 * most)
    good = {1: 1.0, 0: 1.0} | {int(k > 0): v for k, v in share.items()}
    return train_on([_read(x) for _, x in rows], [int(y > 0) for y, _ in rows], good)


def _written(text: str | None) -> bytes:
    seen = np.zeros(BUCKETS, bool)
    seen[indicators(text)] = True
    return zlib.compress(np.packbits(seen).tobytes(), 1)


def _read(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8))).astype(np.int32)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score and predicted to all columns (columns of those names are replaced)."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            found = [m.score(s.as_py()) for s in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(found, pa.float64()), pa.array([int(x >= GOOD) for x in found], pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
