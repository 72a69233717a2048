"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text becomes the multiset of the three- and four-byte windows of its lower-cased words, each hashed to a bucket.
The mean of the buckets' embeddings goes through a linear layer and a softmax. Embeddings and layer are trained by
stochastic gradient descent in numpy on the driver, on a bounded sample (TRAIN_DOCS, shared evenly by the languages;
short snippets of the same texts are added so that short texts are known too). A temperature, fitted on a part kept out of
training, makes the softmax a probability; a text is rejected when its probability is under a threshold that the
same part gives, or when it has no letter.

The model is linear in the mean, so prediction needs only a table of class scores by bucket: that is broadcast, and
its size does not depend on the data.

Defined results: a null text, or one without a letter, is `und` with score 0.0 and rejected; ties go to the language
that comes first in order; an empty table gives an empty table; without any labelled row all texts are `und`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, DIMS = 1 << 14, 16
#: Bound on the rows the model is fitted on.
TRAIN_DOCS = 3000
#: Share of clean texts that the rejection threshold may cost, and the highest threshold.
REJECT_SHARE, REJECT_MOST = 0.002, 0.5
#: Bytes whose windows are counted at once.
CHUNK = 1 << 20
UND = "und"
# ASCII letters become lower case, bytes of other letters stay, all else becomes a blank.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often the windows of a text fall in each bucket."""
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" \0\0\0"
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(data) - 3, CHUNK):
        n = min(CHUNK, len(data) - 3 - lo)
        for k in range(4):
            w = np.frombuffer(data, "<u4", max(0, (n - k + 3) // 4), lo + k)
            for x in (w, w & np.uint32(0xFFFFFF)):
                total += np.bincount((x * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32), minlength=BUCKETS)
    return total


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # class scores by bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, c: np.ndarray) -> np.ndarray:
        return c @ self.scores / max(1, c.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, rejected."""
        if not self.langs or not has_letter(text):
            return UND, 0.0, True
        z = self.logits(counts(text).astype(np.float64)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def _snippets(text: str) -> list[str]:
    """A few words of the text, at places that its CRC gives."""
    words, rng = text.split(), np.random.default_rng(zlib.crc32(text.encode()))
    out = []
    for n in (2, 5, 20):
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return out


def examples(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, windows in each) of a text and of its snippets; none of what has no letter. Their size does
    not grow with the text beyond the number of buckets."""
    if not has_letter(text):
        return []
    out = []
    for x in (text, *_snippets(text)):
        if has_letter(x):
            c = counts(x)
            at = np.flatnonzero(c)
            out.append((at.astype("<u2"), c[at].astype("<u4")))
    return out


def train(texts: list[str | None], labels: list[str], **options) -> Model:
    return train_on([examples(t) for t in texts], labels, **options)


def train_on(found: list[list], labels: list[str], epochs: int = 6, rate: float = 30.0, batch: int = 64, seed: int = 7) -> Model:
    """Fit embeddings and layer to examples() of texts, then temperature and threshold on every fifth text."""
    keep = [(x, y) for x, y in zip(found, labels) if x]
    langs = sorted({y for _, y in keep})
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    rng = np.random.default_rng(seed)
    number = {y: i for i, y in enumerate(langs)}
    apart = [(e, y) for x, y in ([p for i, p in enumerate(keep) if i % 5 == 4] or keep) for e in x]
    rows = [(e, y) for i, (x, y) in enumerate(keep) if i % 5 != 4 or len(keep) < 5 for e in x]
    packed = [(at, (n / n.sum()).astype(np.float32)) for (at, n), _ in rows]
    y = np.array([number[l] for _, l in rows])
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = order[lo : lo + batch]
            x = np.zeros((len(some), BUCKETS), np.float32)
            for r, i in enumerate(some):
                x[r, packed[i][0]] = packed[i][1]
            h = x @ embed
            z = h @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            step = rate * (1 - done / steps)
            back = p @ layer.T
            layer -= 0.1 * step * (h.T @ p)
            bias -= 0.01 * step * p.sum(axis=0)
            embed -= step * (x.T @ back)
            done += 1
    model = Model(langs, embed.astype(np.float64) @ layer, bias.astype(np.float64))
    z = np.array([n @ model.scores[at] / n.sum() + model.bias for (at, n), _ in apart])
    truth = np.array([number[l] for _, l in apart])
    best = (np.inf, 1.0)
    for heat in np.geomspace(0.02, 10, 61):
        q = z / heat - (z / heat).max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), truth]).mean())
        best = min(best, (loss, float(heat)))
    model.temperature = best[1]
    p = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
    model.threshold = min(REJECT_MOST, float(np.quantile(p, REJECT_SHARE)))
    return model


def sample(docs: DataFrame, label: str, most: int) -> DataFrame:
    """Rows (doc_id, text, label), about most of them, with the same expected number of each label, drawn by a hash of
    the id; labels are counted over all rows that may be learnt from."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("text").isNotNull())
    n = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    if not n:
        return usable.select("doc_id", "text", label)
    share = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, most / len(n) / v)))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return usable.where(drawn < F.element_at(share, F.col(label))).select("doc_id", "text", label)


def learnt(rows: DataFrame, label: str, work, most: int) -> list:
    """(label, features) of rows(doc_id, text, label), most of them at most, in order of id and text. work(text) gives
    the features in bytes, of bounded size; so the driver gets no text, and no more than most times that size."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("label", rows.schema[label].dataType), T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found = pa.array([work(s.as_py()) for s in b.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), b.column("label"), found], names=schema.names)

    marked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col(label).alias("label"), "text")
    got = marked.mapInArrow(run, schema).limit(most).collect()
    return [(r.label, bytes(r.features)) for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark, r.label))]


def _written(text: str | None) -> bytes:
    return zlib.compress(b"".join(struct.pack("<I", len(at)) + np.diff(at, prepend=at.dtype.type(0)).tobytes() + n.tobytes() for at, n in examples(text)), 1)


def _read(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at, data = [], 0, zlib.decompress(data)
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        out.append((np.cumsum(np.frombuffer(data, "<u2", n, at + 4), dtype="<u2"), np.frombuffer(data, "<u4", n, at + 4 + 2 * n)))
        at += 4 + 6 * n
    return out


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit to a sample of most rows or so, never over twice as many."""
    rows = learnt(sample(docs.select("doc_id", "text", "lang"), "lang", most), "lang", _written, 2 * most)
    return train_on([_read(x) for _, x in rows], [y for y, _ in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to all columns (columns of those names are replaced)."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "rejected"]
    keep = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            rows = [m.predict(s.as_py()) for s in b.column(text)]
            out = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, [pa.string(), pa.float64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *out], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
