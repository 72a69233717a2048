"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line that is not empty) is hashed to a wide vector; a text's fingerprint is the sum of its paragraphs'
vectors, dense lanes modulo 2^64 and sketch lanes modulo 2^32. So the order of paragraphs does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector. A vector has two parts:

  DENSE lanes    a 512-bit hash of the paragraph; texts with the same multiset agree, others do not
  SKETCH lanes   +1 or -1 for each window of eight bytes of the paragraph (zero bytes behind its end), at a lane and
                 with a sign that the window's hash gives; the cosine of two texts' lanes, read as signed numbers,
                 estimates the cosine of their window counts, which is their likeness; a text has under 2^31
                 bytes, so no lane of it changes its sign

A fingerprint is base64 of these lanes in a row, little-endian.

Defined results: a null or empty text has the zero vector, like to itself (1.0) and to no other (0.0); repeated rows
agree; long texts are hashed whole. A null doc_id comes first in the order of ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DENSE, SKETCH = 8, 240
#: A vector is an array of 32-bit words: two for each dense lane, then the sketch lanes.
HASH = 2 * DENSE
LANES = HASH + SKETCH
WINDOW = 8
NULL_ID = -(1 << 63)
# Odd 64-bit multipliers of the window hash.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_GAP = b"\0" * WINDOW
#: Bytes hashed at once.
CHUNK = 1 << 20


def vector(text: str | None) -> np.ndarray:
    """The fingerprint of a text."""
    paragraphs = [p for p in (text or "").encode().split(b"\n") if p]
    out = np.zeros(LANES, "<u4")
    if not paragraphs:
        return out
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * DENSE).digest() for p in paragraphs)
    out[:HASH] = np.frombuffer(digests, "<u8").reshape(-1, DENSE).sum(axis=0, dtype="<u8").view("<u4")
    lanes = np.zeros(SKETCH, np.int64)
    data = _GAP.join(paragraphs) + _GAP * 2
    starts = np.frombuffer(data, np.uint8) != 0
    for lo in range(0, len(data) - 2 * WINDOW + 1, CHUNK):
        n = min(CHUNK, len(data) - 2 * WINDOW + 1 - lo)
        for k in range(WINDOW):
            count = -(-(n - k) // WINDOW) if n > k else 0
            if not count:
                break
            w = np.frombuffer(data, "<u8", count, lo + k)
            w = w[starts[lo + k : lo + k + count * WINDOW : WINDOW]]
            h = w * _MIX[0]
            h ^= h >> np.uint64(29)
            h *= _MIX[1]
            h >>= np.uint64(40)  # 24 bits: the lowest is the sign, the others choose the lane
            slot = ((h >> np.uint64(1)) * np.uint64(SKETCH) >> np.uint64(23) << np.uint64(1) | h & np.uint64(1)).astype(np.int64)
            found = np.bincount(slot, minlength=2 * SKETCH).reshape(-1, 2)
            lanes += found[:, 0] - found[:, 1]
    out[HASH:] = lanes & 0xFFFFFFFF
    return out


def sketch_of(v: np.ndarray) -> np.ndarray:
    """The sketch lanes, as signed numbers."""
    return v[HASH:].view("<i4").astype(np.int64)


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprint of the union of two multisets (sign 1), or of a without b (sign -1)."""
    out = a + b if sign > 0 else a - b
    x, y = (np.ascontiguousarray(v[:HASH]).view("<u8") for v in (a, b))
    out[:HASH] = (x + y if sign > 0 else x - y).view("<u4")
    return out


def encode(v: np.ndarray) -> str:
    return base64.b64encode(v.tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches, not below 0."""
    if (a == b).all():
        return 1.0
    x, y = sketch_of(a).astype(np.float64), sketch_of(b).astype(np.float64)
    size = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text, in base64."""
    keep = [f for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([encode(vector(s.as_py())) for s in b.column(text)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), found], names=[*(f.name for f in keep), out])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.StringType())]))


def with_next(docs: DataFrame, ranges: int, parts: int) -> DataFrame:
    """Rows dealt by range of doc_id and sorted, each range followed by a copy (last = true) of the row that comes
    after it: the row at the next bound, or the first of all behind the last range. Texts are shuffled once."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    row = docs.agg(F.min("doc_id").alias("low")).first()
    bounds = [b for b in common.bounds_of(docs, "doc_id", ranges) if b != row.low]
    end = len(bounds)
    at = common.range_of(F.col("doc_id"), bounds)
    first = spark.createDataFrame([(b, i) for i, b in enumerate(bounds)] + ([(row.low, end)] if row.low is not None else []), "doc_id long, range int")
    # Copies: one row a range. A bound is a row's id, and only the first of rows that share it follows a range.
    copies = docs.join(F.broadcast(first), "doc_id").groupBy("range").agg(F.min(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("x.doc_id", "x.text", "range", F.lit(True).alias("last"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at.alias("range"), F.lit(False).alias("last"))
    return own.unionByName(copies).repartition(parts, "range").sortWithinPartitions("range", "last", "doc_id", "text")


def compare_neighbours(dealt: DataFrame) -> DataFrame:
    """From with_next(): doc_id, n_chars, edited_sha256, both fingerprints, and the likeness to the edited text's and
    to the next document's. Rows stream by; a task holds one text and the next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for doc, text, part, last in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "last"))):
                mine = vector(text)
                if held and held[2] == part:
                    name, before, _, v = held
                    new = edited(before, text)
                    w = vector(new)
                    out.append((None if name == NULL_ID else name, len(before), hashlib.sha256(new.encode()).hexdigest(), encode(v), encode(w), likeness(v, w), likeness(v, mine)))
                held = None if last else (doc, text, part, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)

    return dealt.mapInArrow(run, schema)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    parts = common.parts(spark)
    return compare_neighbours(with_next(common.table(spark, sf_dir, "documents").select("doc_id", "text"), 4 * parts, parts))
