"""The quality classifier against slow versions: windows, log-count ratios, the dual problem; defined edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filemeta.llm import quality


def slow_indicators(text):
    raw = b" " + (text or "").encode() + b" "
    if len(raw) == 2:
        return []
    fold = bytes(ord("0") if chr(c) in "0123456789" else c for c in raw)
    kind = bytes(ord("a") if c >= 128 or chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c for c in raw)
    out, whole = set(), 1 << 64
    for i in range(len(raw) - 1):
        w = int.from_bytes((fold + b"\0\0")[i : i + 4], "little")
        out.add((w * 2654435761 % (1 << 32)) >> 16)
        out.add(((w & 0xFFFFFF) * 2246822519 % (1 << 32)) >> 16)
    for i in range(len(raw)):
        w = int.from_bytes((kind + b"\0" * 8)[i : i + 8], "little")
        out.add((w * 0x9E3779B97F4A7C15 % whole >> 48) + quality.BYTES)
    return sorted(out)


TEXT = st.text(alphabet="aB9 .é\n$漢", max_size=70)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_indicators_equal_slow_ones(text):
    # The last byte window begins at the last byte but one, as a window has three bytes of its own at least, or a zero.
    assert quality.indicators(text).tolist() == slow_indicators(text)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(9, 40))
def test_pieces_change_nothing(text, chunk):
    whole, before = quality.indicators(text).tolist(), quality.CHUNK
    quality.CHUNK = chunk
    try:
        assert quality.indicators(text).tolist() == whole
    finally:
        quality.CHUNK = before


def test_ratio_is_the_log_count_ratio():
    texts, labels = ["good one"] * 6 + ["BAD $$"] * 6, [1] * 6 + [0] * 6
    model = quality.train(texts, labels)
    counts = {s: np.full(quality.BUCKETS, quality.SMOOTH) for s in (0, 1)}
    for t, y in zip(texts, labels):
        counts[y][slow_indicators(t)] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratio, want)


def objective(x, y, cost, w):
    return 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))


@pytest.mark.parametrize("seed", range(4))
def test_dual_coordinate_descent_reaches_the_least_hinge_loss(seed):
    """Yardstick: projected gradient on the box of the dual, many small steps."""
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(24)]
    ratio, y = rng.normal(0, 1, 12), np.where(rng.random(24) < 0.5, 1, -1)
    cost = np.where(y > 0, 0.7, 1.9)
    x = np.zeros((24, 13))
    for i, at in enumerate(rows):
        x[i, at] = ratio[at] / np.sqrt(ratio[at] @ ratio[at])
    x[:, 12] = 1.0
    kernel = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(24), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1), 0, cost)
    least = objective(x, y, cost, x.T @ (alpha * y))
    w, bias = quality.hinge(rows, y, ratio, cost, epochs=4000)
    assert objective(x, y, cost, np.append(w, bias)) <= least * 1.002 + 1e-6


def test_logistic_curve_has_the_least_loss():
    rng = np.random.default_rng(3)
    margin, weight = rng.normal(0, 2, 300), rng.random(300) + 0.5
    y = np.where(margin + rng.normal(0, 1, 300) > 0, 1, -1)
    slope, shift = quality.logistic(margin, y, weight)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        t = np.where(y > 0, 1 - 1e-3, 1e-3)
        return -(weight / weight.sum() * 300 * (t * np.log(p) + (1 - t) * np.log(1 - p))).sum() + 0.5e-3 * (a * a + b * b)

    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-9 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_score_edges(spark):
    model = quality.train(["good text here"] * 30 + ["x$$$ y%%%"] * 30, [1] * 30 + [0] * 30)
    rows = [(1, "more good text", 5, "own"), (1, "more good text", 5, "own"), (None, None, 6, None), (2, "", 7, ""), (3, "z$$$ " * 400_000, 8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, other string")
    out = quality.score(df, model).collect()
    assert [r.other for r in out] == [r[3] for r in rows] and out[0] == out[1] and out[2].score == out[3].score == model.score("")
    assert out[0].predicted == 1 and out[4].predicted == 0 and abs(out[4].score - model.score("z$$$ " * 3)) < 0.2
    empty = quality.score(df.where("doc_id > 9"), model)
    assert empty.columns == ["doc_id", "text", "other", "score", "predicted"] and empty.count() == 0


def test_fit_with_null_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "x$$$ y%%%") for i in range(80)] * 2 + [(None, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i > 3 else None, 0) for i in range(80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model.score("good text") > 0.7 > model.score("q$$$ w%%%")
