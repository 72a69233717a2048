"""Pipeline stages and packing on nulls, empty texts, repeated rows, odd ids, empty and wider tables."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from filemeta.llm import common, packing

WORDS = P.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def own_folder(spark, tmp_path, rows):
    """The small tables with rows of our own added; lang and n_chars of these are null."""
    docs = common.table(spark, SMALL, "documents")
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = common.table(spark, SMALL, "labels")
    odd = spark.createDataFrame([(None, 1, None), (10**9, None, None), (10**9 + 7, 1, 0)], labels.schema)
    labels.unionByName(odd).write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_rows_of_our_own_go_through_all_stages(spark, tmp_path):
    good = next(r.text for r in common.table(spark, SMALL, "documents").join(common.table(spark, SMALL, "labels").where("quality = 1"), "doc_id").collect() if len(r.text.split()) > 80)
    rows = [(None, None), (None, ""), (10**9, " \n "), (10**9 + 1, good + " tail one"), (10**9 + 1, good + " tail one"), (None, good + " tail two"), (10**9 + 2, "12345 !!"), (10**9 + 3, good + " <|endoftext|>")]
    sf, kept = own_folder(spark, tmp_path, rows), []
    docs = common.table(spark, sf, "documents")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = common.stored(spark, out, name)
        kept.append(docs)
    first = {(r.doc_id, r.text) for r in kept[0].collect()}
    assert not any(t is None or not t.strip() or t == "12345 !!" for _, t in first) and (10**9 + 3, rows[-1][1]) in first
    near = [r for r in kept[3].collect() if r.text.startswith(good[:200])]
    assert len(near) == 1  # near copies, repeated rows and a null id among them: one stays
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept[3].collect())
    assert sorted({(r.doc_id is not None, r.doc_id or 0) for r in docs.collect()}) == sorted(set(ids))


def test_empty_tables(spark, tmp_path):
    for n in ("documents", "labels"):
        common.table(spark, SMALL, n).where("doc_id < -1").write.parquet(f"file://{tmp_path}/{n}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_a_later_run_leaves_the_tables_of_an_earlier_result(spark):
    from filemeta.llm import huffman

    lazy = huffman.op9_token_files(spark, SMALL)
    docs = common.table(spark, SMALL, "documents")
    cp.STAGES[0][1](spark, docs, SMALL)
    cp.STAGES[2][1](spark, docs, SMALL)
    assert lazy.count() == docs.count()


@pytest.mark.parametrize("rows", [[(None, "a b"), (None, "a b"), (4, None), (4, "c " * 5000), (4, "d"), (-7, "")], []])
def test_packing_with_null_and_repeated_ids(spark, rows):
    library = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, length string").coalesce(1)
    out = packing.pack(df, WORDS).collect()
    whole = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    want = sorted((i is None, i or 0, len(w)) for (i, _), w in zip(rows, whole))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(map(len, whole))
    crc = {zlib.crc32(np.array(w[s : s + n], "<u4").tobytes()) for w in whole for s, n in {(r.start, r.length) for r in out}}
    assert {r.ids_crc32 for r in out} <= crc
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in at.values())
