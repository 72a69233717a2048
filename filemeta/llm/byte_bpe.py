"""Byte-level BPE by a monoid tree reduction, and decoding by concatenation up a tree.

Encoding a piece: cut it in halves down to short leaves, merge each leaf by ranks, then join neighbours. A join
re-encodes a window of the tokens next to the boundary and grows it until both tokens just outside are compatible
with the window's edge tokens, where tokens a and b are compatible if merging the bytes of a + b gives a, b again. A sequence
whose adjacent tokens are all compatible is the sequence that merging the whole piece gives, so nothing further out
can change: join is exact, and associative on encodings, and the empty piece is its unit.

Texts are first cut by the vocabulary's pattern, each match on its own. A match that is itself in the vocabulary is
that token, as in the tiktoken library. Encoded halves of words and chunks (a run without white space and the blank
before it; for a pattern other than PATTERN, a match) are kept by a worker up to a bound.

Defined results: a null or empty text has no tokens; lone surrogates cannot occur in Spark strings; repeated rows,
ties and empty tables need no special case; other columns pass through, and one named like the output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Bytes of a leaf that is merged directly; longer pieces go through halves and joins.
LEAF = 2
#: Halves up to so many bytes recur in many words, so that their encodings are kept, as are merges of two tokens, up to
#: numbers of them.
PART, PARTS, PAIRS = 6, 120_000, 150_000
#: Chunks a worker keeps twice over: with so many new ones, those not met since the last so many go.
CACHE = 200_000
NO_RANK = 1 << 60
#: Rows of text that are encoded, or decoded, before they go out.
ROWS = 1000
#: Leaves of the decoding tree have so many ids.
DECODE_LEAF = 4096
# Fixed value: the pattern that public byte-level vocabularies of about 50,000 entries were made with. Its matches
# never look across white space, so that texts of it can be cut in chunks first; for others every match is kept.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed values (SPACE): Unicode's White_Space property.
#: ASCII punctuation that the pattern cuts off behind a letter: no apostrophe, which begins a contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LOADED: dict[tuple[str, str], "ByteBPE"] = {}


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.match = regex.compile(pattern)
        self.by_chunk = pattern == PATTERN
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.pairs: dict[int, list[int] | None] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteBPE":
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of ties, until none is in the vocabulary."""
        get, cuts = self.ranks.get, list(range(len(piece) + 1))
        scores = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while scores and (low := min(scores)) != NO_RANK:
            i = scores.index(low)
            del cuts[i + 1], scores[i]
            if i:
                scores[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NO_RANK)
            if i < len(scores):
                scores[i] = get(piece[cuts[i] : cuts[i + 2]], NO_RANK)
        return [self.ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])]

    def pair(self, a: int, b: int) -> list[int] | None:
        """What merging the bytes of two tokens gives; None if they are compatible."""
        key = a << 32 | b
        if key in self.pairs:
            return self.pairs[key]
        found = self.merge(self.bytes_of[a] + self.bytes_of[b])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = None if found == [a, b] else found
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings."""
        if not left or not right or (found := self.pair(left[-1], right[0])) is None:
            return left + right
        width = 1
        while True:
            lo, hi = max(0, len(left) - width), min(len(right), width)
            if (lo == 0 or self.pair(left[lo - 1], found[0]) is None) and (hi == len(right) or self.pair(found[-1], right[hi]) is None):
                return left[:lo] + found + right[hi:]
            width *= 2
            found = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-width:] + right[:width])))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The piece itself where the vocabulary has it, as the library has it, else by tree reduction."""
        rank = self.ranks.get(piece)
        return self.reduce(piece) if rank is None else [rank]

    def reduce(self, piece: bytes) -> list[int]:
        """Encode the halves, then join them."""
        n = len(piece)
        if n <= LEAF:
            return self.merge(piece) if piece else []
        if n > PART:
            return self.join(self.reduce(piece[: n // 2]), self.reduce(piece[n // 2 :]))
        found = self.parts.get(piece)
        if found is None:
            found = self.join(self.reduce(piece[: n // 2]), self.reduce(piece[n // 2 :]))
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[piece] = found
        return found

    def _ids(self, pieces: list[str]) -> bytes:
        ids = [t for m in pieces for t in self.encode_piece(m.encode())]
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return self._ids(self.match.findall(chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        if not self.by_chunk:
            pieces = [m.group() for m in self.match.finditer(text)]
            for p in set(pieces).difference(cache):
                cache[p] = old.get(p) or self._ids([p])
            return b"".join(map(cache.__getitem__, pieces))
        chunks = _CHUNK.findall(text)
        for c in set(chunks).difference(cache):
            found = old.get(c)
            if found is None:
                word = c.rstrip(TAIL)
                if word and word != c and ("a" <= word[-1] <= "z" or "A" <= word[-1] <= "Z"):
                    if (first := cache.get(word) or old.get(word)) is None:
                        first = cache[word] = self._chunk(word)
                    found = first + self._chunk(c[len(word) :])
                else:
                    found = self._chunk(c)
            cache[c] = found
        return b"".join(map(cache.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> bytes:
        """Leaves of ids become bytes; neighbours are concatenated up the tree."""
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[i : i + DECODE_LEAF].tolist())) for i in range(0, len(ids), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode_table(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add each text's ids as a binary column of little-endian unsigned 32-bit integers, in place of the text."""
    keep = [f for f in df.schema.fields if f.name not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(path, pattern)
        for b in _slices(batches):
            out = pa.array([bpe.encode(s.as_py() or "") for s in b.column(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), out], names=[*(f.name for f in keep), ids])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(ids, T.BinaryType())]))


def decode_table(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Add the bytes that the ids stand for (null ids: null), keeping the ids."""
    keep = [f for f in df.schema.fields if f.name != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(path, pattern)
        for b in _slices(batches):
            out = pa.array([None if v is None else bpe.decode(np.frombuffer(v, "<u4")) for v in (s.as_py() for s in b.column(ids))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), out], names=[*(f.name for f in keep), data])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(data, T.BinaryType())]))


def op7_byte_bpe(spark, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    common.ship(spark)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode_table(encode_table(docs, path, pattern), path, pattern)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )
