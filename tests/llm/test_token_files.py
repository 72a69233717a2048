"""The written tables alone decode a token file."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from filemeta.llm import common, huffman


def test_written_tables_decode_alone(spark, tmp_path):
    spark.createDataFrame([(1, "the one and the other"), (2, "")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    with common.noted() as written:
        rows = huffman.op9_token_files(spark, f"file://{tmp_path}").collect()
    paths = {p.split("filemeta-")[-1].split("-")[0]: p for p in written}
    found = {r.doc_id: r for r in huffman.read_blocks(spark.read.parquet(paths["blocks"]), spark.read.parquet(paths["codes"])).collect()}
    assert {d: r.ids_crc32 for d, r in found.items()} == {r.doc_id: r.ids_crc32 for r in rows}
    table = [x for p in glob.glob(paths["codes"].removeprefix("file://") + "/*.parquet") for x in pq.read_table(p).to_pylist()]
    assert {x["id"] for x in table} == {int(i) for r in found.values() for i in np.frombuffer(r.ids, "<u4")}


def test_a_vocabulary_of_300000_ids():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300_000) ** 2
    lengths = huffman.code_lengths(counts, 19)
    ids = np.concatenate([rng.permutation(300_000), rng.integers(0, 300_000, 5000)]).astype("<u4")
    assert lengths.max() > 17 and sum(2.0 ** -lengths.astype(int)) == 1
    bits, marks = huffman.encode_bits(ids, huffman.canonical(lengths), lengths)
    tokens = np.minimum(huffman.STRIDE, len(ids) - np.arange(len(marks)) * huffman.STRIDE)
    assert (huffman.decode_block(np.frombuffer(bits, np.uint8), marks, tokens, huffman.lookup(lengths)) == ids).all()


@pytest.mark.parametrize("limit", [13, 17, 18, 25])
def test_codes_of_every_length_up_to_the_limit(limit):
    counts = 2 ** np.arange(30)  # as skewed as the limit lets it be
    lengths = huffman.code_lengths(counts, limit)
    ids = np.random.default_rng(limit).integers(0, 30, 3000).astype("<u2")
    assert lengths.max() == limit
    bits, marks = huffman.encode_bits(ids, huffman.canonical(lengths), lengths)
    tokens = np.minimum(huffman.STRIDE, len(ids) - np.arange(len(marks)) * huffman.STRIDE)
    assert (huffman.decode_block(np.frombuffer(bits, np.uint8), marks, tokens, huffman.lookup(lengths)) == ids).all()


def test_longer_codes_are_refused():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(3, int), 26)


def test_block_borders_change_nothing(spark, monkeypatch):
    """Blocks of a few tokens, documents of several strides, one id with several texts."""
    rng = np.random.default_rng(2)
    rows = [(d, rng.integers(0, 40, n).astype("<u2")) for d, n in [(1, 900), (1, 3), (2, 257), (3, 1), (9, 256), (10, 512), (11, 1)]]
    lengths = huffman.code_lengths(np.bincount(np.concatenate([x for _, x in rows]), minlength=40))
    ids = spark.createDataFrame([(d, x.tobytes()) for d, x in rows], "doc_id long, ids binary")
    for stride_tokens in (1, 300, 1 << 19):
        blocks = huffman.write_blocks(ids, lengths, "<u2", [2, 9], 2, stride_tokens)
        found = huffman.read_blocks(blocks, huffman.write_codes(spark, lengths)).collect()
        assert sorted((r.doc_id, bytes(r.ids)) for r in found) == sorted((d, x.astype("<u4").tobytes()) for d, x in rows)
        assert blocks.count() in {1: (7,), 300: (4, 5), 1 << 19: (3,)}[stride_tokens]  # rows of one id are in any order


def test_range_of(spark):
    for bounds in ([], [5], [1, 2, 3], [-4, 0, 7, 9, 9 * 10**15], list(range(0, 400, 3))):
        keys = sorted({x + d for x in bounds for d in (-1, 0, 1)} | {-(1 << 63), (1 << 63) - 1})
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", common.range_of(F.col("k"), bounds).alias("r")).collect()
        assert [r.r for r in rows] == [sum(b <= r.k for b in bounds) for r in rows]
