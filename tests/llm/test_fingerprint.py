"""Lanes past the 16-bit range, texts over many pieces, odd ids."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filemeta.llm import fingerprint


@pytest.mark.parametrize("text, after", [("x" * 40_000, "x" * 40_000 + " and an end"), ((" " * 24 + "a line\n") * 2300, (" " * 24 + "a line\n") * 2290 + "another end")])
def test_windows_repeated_over_32767_times(text, after):
    a, b = fingerprint.vector(text), fingerprint.vector(after)
    assert np.abs(fingerprint.sketch_of(a)).max() > 32767
    assert fingerprint.likeness(a, b) > 0.99
    both = fingerprint.combine(a, b)
    assert (both == fingerprint.vector(text + "\n" + after)).all() and (fingerprint.combine(both, b, -1) == a).all()
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()


def test_a_paragraph_repeated_65536_times_is_not_the_empty_text():
    v = fingerprint.vector("a line\n" * 65536)
    assert (v[: fingerprint.HASH] != 0).any() and (v != fingerprint.vector("")).any() and (v != fingerprint.vector("other line\n" * 65536)).any()


def test_a_long_text_of_one_line_is_like_its_edit():
    """2 MB of one line: the sketch's cosine is within 0.05 of the one without lanes, of the windows' counts."""
    text = "the same line again and again\n" * 70_000
    new = fingerprint.edited(text, "quite another text of other words and lines\n" * 40_000)

    def windows(t):
        found = Counter()
        for p, n in Counter(x for x in t.encode().split(b"\n") if x).items():
            for i in range(len(p)):
                found[p[i : i + 8].ljust(8, b"\0")] += n
        return found

    a, b = windows(text), windows(new)
    exact = sum(a[k] * b[k] for k in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    assert abs(fingerprint.likeness(fingerprint.vector(text), fingerprint.vector(new)) - exact) < 0.05


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé\n b", max_size=90), st.integers(8, 40))
def test_pieces_change_nothing(text, chunk):
    whole, before = fingerprint.vector(text), fingerprint.CHUNK
    fingerprint.CHUNK = chunk
    try:
        assert (fingerprint.vector(text) == whole).all()
    finally:
        fingerprint.CHUNK = before


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "first\ntext", 1), (None, "first\ntext", 1), (3, None, 2), (3, "three", 3), (5, "long " * 300_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    out = fingerprint.fingerprint(df).collect()
    assert [r.fingerprint for r in out] == [fingerprint.encode(fingerprint.vector(r[1])) for r in rows]
    for ranges in (1, 3, 8):
        got = fingerprint.compare_neighbours(fingerprint.with_next(df, ranges, 4)).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars) for r in got) == [(-1, 10), (-1, 10), (3, 0), (3, 5), (5, 1_500_000)]
    assert fingerprint.compare_neighbours(fingerprint.with_next(df.where("text = 'x'"), 3, 2)).count() == 0
