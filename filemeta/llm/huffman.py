"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

Format. A code is a table of (id, length) rows, from which the canonical codes follow: shorter lengths first, ids
ascending within a length, most significant bit first. A block is a row of the block table:

  range, block       where the block stands in the file's order
  total              its tokens
  docs               document ids, little-endian 64-bit
  tokens             tokens of each document, little-endian 64-bit
  starts             byte at which each document's bits begin, little-endian 64-bit
  marks              for each document, the bit offset within its bits of every STRIDE-th token, little-endian 64-bit
  bits               the documents' code bits, each document padded to a byte

Blocks hold whole documents in ascending order of id, and any block can be decoded alone: lanes that start at the
marks go through a table of 2^limit entries side by side, a token a step.

Defined results: a null or empty text is its end id alone; an empty table gives empty tables; documents that share
an id stay rows of their own, in any order; further columns are not read. A null document id is stored as the
smallest 64-bit integer, so it comes first, and is read back as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_tokens import ROWS, WordTokens

STRIDE = 256
BLOCK_TOKENS = 1 << 19
LIMIT = 16
#: Bits that a code may have at most, as its prefix is read from 32 bits that begin at a byte.
LONGEST = 25
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over limit bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit or limit > LONGEST:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits, or these are over {LONGEST}")
    order = np.argsort(counts[used], kind="stable")
    leaf = counts[used][order].astype(np.float64)
    # Rows of each level in ascending weight: which are leaves, and after the last level how many rows are taken.
    kinds, weights = [np.ones(n, bool)], leaf
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        kinds.append(at < n)
        weights = both[at]
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used[order]] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id; ids without a length get 0."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0].astype(np.int64)
    if len(order):
        size = lengths[order].astype(np.int64)
        width = int(size.max())
        at = np.concatenate([[0], np.cumsum(1 << (width - size))[:-1]])
        codes[order] = at >> (width - size)
    return codes


def lookup(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the table's index, and id and length for each prefix."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    times = 1 << (width - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    filled = int(times.sum())
    ids[:filled], size[:filled] = np.repeat(order, times), np.repeat(lengths[order], times)
    return width, ids, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits padded to a byte, and the bit offset of every STRIDE-th token."""
    data, _, marks = encode_many(ids, np.array([0, len(ids)]), codes, lengths)
    return data, marks[0]


def encode_many(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Runs of ids between bounds, each run's code bits from a byte on: all bytes, the runs' byte bounds, and for each
    run the bit offset, within it, of every STRIDE-th token."""
    size = lengths[ids].astype(np.int64)
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    bits = ends[bounds]
    cuts = np.zeros(len(bounds), np.int64)
    np.cumsum((np.diff(bits) + 7) // 8, out=cuts[1:])
    start = ends[:-1] + np.repeat(cuts[:-1] * 8 - bits[:-1], np.diff(bounds))
    # A code that begins within a byte covers so many bytes at most: three for codes of up to 17 bits.
    span = (int(lengths.max(initial=1)) + 14) // 8
    word, byte = codes[ids].astype(np.int64) << (8 * span - size - (start & 7)), start >> 3
    out = np.zeros(int(cuts[-1]) + span)
    for k in range(span):
        out += np.bincount(byte + k, (word >> (8 * (span - 1 - k))) & 255, len(out))
    marks = [start[a:b:STRIDE] - 8 * c for a, b, c in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist())]
    return out[: int(cuts[-1])].astype(np.uint8).tobytes(), cuts, marks


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column without nulls in a row."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, kind)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])).view(kind)


def decode_block(bits: np.ndarray, at: np.ndarray, tokens: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of lanes that begin at bits at and have so many tokens, one lane after the other."""
    width, ids, size = table
    data = np.concatenate([bits, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    order = np.argsort(-tokens, kind="stable")
    pos, left = at[order].copy(), tokens[order]
    first = np.concatenate([[0], np.cumsum(tokens)[:-1]])[order] if len(tokens) else at
    out = np.empty(int(tokens.sum()), np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than step tokens
        p = pos[:n]
        prefix = (words[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & ((1 << width) - 1)
        out[first[:n] + step] = ids[prefix]
        pos[:n] = p + size[prefix]
    return out


def tokenised(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, 16-bit where the vocabulary allows it, the end id included; and a row of each task that has the
    counts of its ids, a 64-bit integer for each id of the vocabulary, in place of them."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(path)
        kind = "<u2" if words.size <= 1 << 16 else "<u4"
        end, total = np.array([end_id], kind).tobytes(), np.zeros(words.size, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                out = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in words.encode(b.column(text))]
                total += np.bincount(np.frombuffer(b"".join(out), kind), minlength=words.size)
                yield pa.RecordBatch.from_arrays([b.column(doc_id).cast(pa.int64()).fill_null(NULL_ID), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=schema.names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=schema.names)

    return df.select(doc_id, text).mapInArrow(run, schema)


def global_counts(stored: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids, from the tasks' counts: summed by partition, then by id; the driver gets a row per id of the
    vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for v in b.column("counts"):
                total += np.frombuffer(v.as_buffer(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = stored.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_blocks(ids: DataFrame, lengths: np.ndarray, kind: str, bounds: list[int], ranges: int, stride_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The block table: documents are encoded where they lie, dealt by range of id, sorted, and gathered in blocks."""
    spark = ids.sparkSession
    known = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary
    coded = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("marks", T.BinaryType()), T.StructField("bits", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = known.value
        codes = canonical(size)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                tokens = pc.binary_length(part.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
                bounds = np.concatenate([[0], np.cumsum(tokens)])
                data, cuts, marks = encode_many(_flat(part.column("ids"), kind), bounds, codes, size)
                cuts = cuts.tolist()
                bits = pa.array([data[i:j] for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens), pa.array([m.astype("<i8").tobytes() for m in marks], pa.binary()), bits], names=coded.names)

    block = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("total", T.LongType())] + [T.StructField(n, T.BinaryType()) for n in ("docs", "tokens", "starts", "marks", "bits")])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now, number = [], 0, None, 0

        def out() -> pa.RecordBatch:
            sizes = np.array([len(r[3]) for r in rows], "<i8")
            one = [now, number, held, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), (np.cumsum(sizes) - sizes).astype("<i8").tobytes(), b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5)], names=block.names)

        for b in batches:
            for r, doc, n, marks, bits in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "tokens", "marks", "bits"))):
                if rows and (r != now or held >= stride_tokens):
                    yield out()
                    rows, held, number = [], 0, number + 1
                if r != now:
                    now, number = r, 0
                rows.append((doc, n, marks, bits))
                held += n
        if rows:
            yield out()

    dealt = ids.mapInArrow(encode, coded).withColumn("range", common.range_of(F.col("doc_id"), bounds))
    return dealt.repartition(ranges, "range").sortWithinPartitions("range", "doc_id").mapInArrow(gather, block)


def write_codes(spark, lengths: np.ndarray) -> DataFrame:
    """The code table: id and length of each id that has a code."""
    used = np.flatnonzero(lengths)
    return spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id int, length int")


def read_codes(codes: DataFrame) -> np.ndarray:
    """Code lengths by id, from the code table; the driver gets a row per id of the vocabulary."""
    rows = codes.toPandas()
    ids = rows["id"].to_numpy(np.int64)
    lengths = np.zeros(int(ids.max(initial=-1)) + 1, np.uint8)
    lengths[ids] = rows["length"].to_numpy(np.uint8)
    return lengths


def read_blocks(blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """Decoded documents, from the block table and the code table alone: range, block, doc_id, before (tokens before it in its block), n_tokens, ids_crc32 and
    ids, as little-endian unsigned 32-bit integers."""
    known = blocks.sparkSession.sparkContext.broadcast(read_codes(codes))
    schema = "range int, block int, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup(known.value)
        for b in batches:
            for row in b.to_pylist():
                docs, tokens, starts = (np.frombuffer(row[c], "<i8") for c in ("docs", "tokens", "starts"))
                lanes = -(-tokens // STRIDE)
                marks = np.frombuffer(row["marks"], "<i8") + np.repeat(starts * 8, lanes)
                within = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
                ids = decode_block(np.frombuffer(row["bits"], np.uint8), marks, np.minimum(STRIDE, np.repeat(tokens, lanes) - within * STRIDE), table).astype("<u4")
                before = np.cumsum(tokens) - tokens
                data = [ids[a : a + n].tobytes() for a, n in zip(before.tolist(), tokens.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["range"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(docs), pa.array(before), pa.array(tokens), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary())],
                    names=["range", "block", "doc_id", "before", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.select("range", "block", "docs", "tokens", "starts", "marks", "bits").mapInArrow(run, schema)


def block_starts(blocks: DataFrame) -> DataFrame:
    """Tokens before each block. Sums by range come first, so that the only ordering of everything is over a row per
    range; blocks are then ordered within their range."""
    by_range = blocks.groupBy("range").agg(F.sum("total").alias("sum"))
    offsets = by_range.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("range_start"))
    inner = Window.partitionBy("range").orderBy("block")
    return blocks.select("range", "block", (F.sum("total").over(inner) - F.col("total")).alias("in_range")).join(offsets, "range").select("range", "block", (F.col("range_start") + F.col("in_range")).alias("block_start"))


def op9_token_files(spark, sf_dir: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    import public_tokenizers

    common.ship(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs, ranges = common.table(spark, sf_dir, "documents"), common.parts(spark)
    stored = common.stored(spark, tokenised(docs, path, end_id), "ids")
    ids = stored.where("counts is null").select("doc_id", "ids")
    size = WordTokens.of(path).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    lengths = code_lengths(global_counts(stored, size), max(LIMIT, int(np.ceil(np.log2(size)))))
    blocks = common.stored(spark, write_blocks(ids, lengths, kind, common.bounds_of(ids, "doc_id", 4 * ranges), ranges), "blocks")
    codes = common.stored(spark, write_codes(spark, lengths), "codes")
    found = read_blocks(blocks, codes).drop("ids")
    starts = block_starts(blocks.select("range", "block", "total"))
    return found.join(starts, ["range", "block"]).select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
