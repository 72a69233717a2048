"""Words go through halves and joins; patterns and tables of other kinds."""

import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from filemeta.llm import byte_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PROSE = "/root/testdata/sf0.001/documents.parquet"


def library(pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(monkeypatch, pattern=P.PATTERN):
    bpe, joins = byte_bpe.ByteBPE(RANKS, pattern), []
    join = bpe.join
    monkeypatch.setattr(bpe, "join", lambda a, b: joins.append(1) or join(a, b))
    return bpe, joins


def test_words_outside_the_vocabulary_are_joined(monkeypatch):
    bpe, joins = counted(monkeypatch)
    for word in (b" thonerqx", b"zqxj", b"oftheathanwhst"):
        assert word not in bpe.ranks
        before = len(joins)
        assert bpe.encode_piece(word) == bpe.merge(word) and len(joins) > before


def test_documents_go_through_joins(spark, monkeypatch):
    bpe, joins = counted(monkeypatch)
    whole = library(P.PATTERN)
    texts = [r.text for r in spark.read.parquet(PROSE).select("text").collect() if r.text]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == whole.encode_ordinary(t)
    assert len(joins) > len(texts)


@pytest.mark.parametrize("pattern", [r"[a-z]+|[^a-z]+", r"(?s:.{1,40})", r"\S+\s*|\s+", r"(a+)|[^a]+"])
def test_other_patterns_are_not_cut_in_chunks(pattern):
    for text in ("one, two  three\nfour five-six", "aab " * 50, "", "é漢 x\t\ty"):
        assert np.frombuffer(byte_bpe.ByteBPE(RANKS, pattern).encode(text), "<u4").tolist() == library(pattern).encode_ordinary(text)


def test_caches_that_overflow_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    monkeypatch.setattr(byte_bpe, "PARTS", 2)
    bpe, whole = byte_bpe.ByteBPE(RANKS, P.PATTERN), library(P.PATTERN)
    for text in ("zqxj thonerqx wvutsrq abab", "abab zqxj!! thonerqx,", "x " * 20, "xq" * 3000):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == whole.encode_ordinary(text)


def test_empty_table_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "ab c", "mine", "own")], "doc_id long, text string, ids string, data string")
    for df, n in ((rows, 1), (rows.where("doc_id < 0"), 0)):
        out = byte_bpe.decode_table(byte_bpe.encode_table(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
        assert len(out) == n
        if n:
            assert (out[0].doc_id, out[0].data) == (1, bytearray(b"ab c"))
