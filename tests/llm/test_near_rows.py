"""The near-duplicate stage where ids are repeated or null."""

import numpy as np
import pytest

import corpus_pipeline
from filemeta.llm import common, components, near_dedup

A, B, C = ("one two three four five six seven eight", "an other text that is like none of these at all", "a third text which shares an id with some one else here")


def test_one_row_of_each_group_stays(spark):
    rows = [(None, A), (None, A), (None, B), (1, A), (2, C), (2, C), (3, C + " x"), (5, B + " end"), (5, "quite unlike the rest of them and so it must stay"), (None, ""), (None, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_near(spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(None, A), (None, B), (2, C), (5, "quite unlike the rest of them and so it must stay"), (None, ""), (7, ""), (8, None)], key=str)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    """Two texts of null id, or of one id, with nothing in common, and a near copy of each: two components."""
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    for shared in (None, 1):
        rows = [(shared, long), (shared, other), (5, long + " x"), (6, other + " y"), (6, other + " y")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_dedup.near_groups(df, 3, 85).collect()
        assert len(got) == 5 and all(r.component_id == shared for r in got)
        assert sorted((r.doc_id is None, r.doc_id, r.kept) for r in got if r.doc_id != shared) == [(False, 5, False), (False, 6, False), (False, 6, False)]
        out = corpus_pipeline.dedup_near(spark, df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars"), "")
        assert sorted(r.text for r in out.collect()) == sorted([long, other])


def test_repeated_rows_of_the_pipeline_leave_once(spark):
    row = (3, " ".join(f"c{i}" for i in range(40)), "en", "s", 1)
    df = spark.createDataFrame([row, row, (None, row[1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.dedup_near(spark, df, "").collect()] == [None]


def hot(spark, sets, block):
    """One bucket of so many sets, each a component of its own, dealt in blocks of so many."""
    n = -(-len(sets) // block)
    rows = [(0, k, k, k % n, min(k % n, o), max(k % n, o)) for k in range(len(sets)) for o in range(n)]
    rest = spark.createDataFrame(rows, "key long, rep long, comp long, block int, i int, j int")
    known = [(k, (near_dedup.signature(x) & np.uint32(255)).astype(np.uint8).tobytes(), x.tobytes(), len(x)) for k, x in enumerate(sets)]
    return rest, spark.createDataFrame(known, "rep long, sig binary, items binary, n_shingles long")


def joined(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [7, 25, 1000])
def test_blocks_of_a_hot_bucket_equal_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base, sets = np.unique(rng.integers(1, 1 << 62, 80).astype(np.uint64)), []
    for k in range(60):
        own = rng.integers(1, 1 << 62, int(rng.integers(4, 30))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([base[int(rng.integers(0, 12)) :], own]) if k % 3 else np.concatenate([own, own + np.uint64(7)])))
    want = joined([(a, b) for a in range(60) for b in range(a) if near_dedup.linked(sets[a], sets[b], 80)], 60)
    rest, known = hot(spark, sets, block)
    assert joined([(r.u, r.v) for r in near_dedup.compare_blocks(rest, known, 80, 3).collect()], 60) == want


def test_full_sets_go_only_to_members_that_a_signature_leaves(spark):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(1, 1 << 62, 20).astype(np.uint64)) for _ in range(400)]
    sets[7] = sets[300].copy()
    with common.noted() as written:
        rest, known = hot(spark, sets, 100)
        links = near_dedup.compare_blocks(rest, known, 80, 3).collect()
    assert [sorted(x) for x in links] == [[7, 300]]
    assert {r.rep for r in spark.read.parquet(written[0]).collect()} == {7, 300}


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """One written table for a long chain, a star and repeated and self links; as the rounds of stars find them."""
    links = [(k + 1, k) for k in range(90, 60, -1)] + [(200 - k, 200) for k in range(20)] + [(5, 5), (-7, 300), (300, -7), (61, 12)]
    df, found = spark.createDataFrame(links, "u long, v long"), []
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        with common.noted() as written:
            found.append(sorted(tuple(r) for r in components.connected_components(spark, df).collect()))
        assert (len(written) == 1) == (few > 0)
    assert found[0] == found[1] and (91, 12) in found[0] and (300, -7) in found[0] and len(found[0]) == 32 + 20 + 2
