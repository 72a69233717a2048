"""Language identification against slow versions: windows, the gradient, the softmax; defined edge cases."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from filemeta.llm import langid

TEXT = st.text(alphabet="abÉ é1.\n漢", max_size=60)


def slow_counts(text):
    words, word = [], b""
    for c in text.lower().encode() + b" ":
        if 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            words, word = words + [word], b""
    data = b" " + b" ".join(words) + b" \0\0\0"
    out = np.zeros(langid.BUCKETS, int)
    for i in range(len(data) - 3):
        w = int.from_bytes(data[i : i + 4], "little")
        for x in (w, w & 0xFFFFFF):
            out[(x * 2654435761 % (1 << 32)) >> 18] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_counts_equal_slow_ones(text):
    assert (langid.counts(text) == slow_counts(text)).all()


@settings(max_examples=50, deadline=None)
@given(TEXT, st.integers(5, 30))
def test_pieces_change_nothing(text, chunk):
    whole, before = langid.counts(text), langid.CHUNK
    langid.CHUNK = chunk
    try:
        assert (langid.counts(text) == whole).all()
    finally:
        langid.CHUNK = before


def test_one_step_is_the_gradient_of_the_loss():
    """Training for one step from the seeded start, against differences of the loss itself."""
    texts, labels = ["der und die das", "the of and to", "und nicht der", "of the to in"], ["de", "en", "de", "en"]
    found = [langid.examples(t) for t in texts]
    rows = [(e, y) for x, y in zip(found, labels) for e in x]
    rate = 0.5
    model = langid.train_on(found, labels, epochs=1, rate=rate, batch=len(rows), seed=3)
    rng = np.random.default_rng(3)
    embed = rng.normal(0, 0.1, (langid.BUCKETS, langid.DIMS)).astype(np.float32).astype(float)
    layer = rng.normal(0, 0.1, (langid.DIMS, 2)).astype(np.float32).astype(float)
    x = np.zeros((len(rows), langid.BUCKETS))
    for r, ((at, n), _) in enumerate(rows):
        x[r, at] = n / n.sum()
    truth = np.array([["de", "en"].index(y) for _, y in rows])

    def loss(e, w, b):
        z = x @ e @ w + b
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()

    used, step = np.flatnonzero(x.any(axis=0))[:6], 1e-5
    grad_layer, grad_bias, grad_embed = np.zeros_like(layer), np.zeros(2), np.zeros((len(used), langid.DIMS))
    for k in np.ndindex(layer.shape):
        d = np.zeros_like(layer)
        d[k] = step
        grad_layer[k] = (loss(embed, layer + d, 0) - loss(embed, layer - d, 0)) / (2 * step)
    for k in range(2):
        d = np.zeros(2)
        d[k] = step
        grad_bias[k] = (loss(embed, layer, d) - loss(embed, layer, -d)) / (2 * step)
    for i, u in enumerate(used):
        for k in range(langid.DIMS):
            d = np.zeros_like(embed[u])
            d[k] = step
            kept = embed[u].copy()
            embed[u] = kept + d
            up = loss(embed, layer, 0)
            embed[u] = kept - d
            grad_embed[i, k] = (up - loss(embed, layer, 0)) / (2 * step)
            embed[u] = kept
    new_layer = layer - 0.1 * rate * grad_layer
    want = (embed[used] - rate * grad_embed) @ new_layer
    assert np.abs(model.scores[used] - want).max() < 1e-4 and np.abs(model.bias + 0.01 * rate * grad_bias).max() < 1e-5


def test_prediction_is_a_softmax_and_ties_go_in_order():
    model = langid.Model(["b", "c"], np.zeros((langid.BUCKETS, 2)), np.zeros(2))
    assert model.predict("abc") == ("b", 0.5, False) and model.predict(None) == ("und", 0.0, True) and model.predict("1 .") == ("und", 0.0, True)
    rng = np.random.default_rng(1)
    model = langid.Model(["b", "c", "d"], rng.normal(0, 1, (langid.BUCKETS, 3)), rng.normal(0, 1, 3), 0.7, 0.9)
    c = slow_counts("eine kleine frage")
    z = (c @ model.scores / c.sum() + model.bias) / 0.7
    p = np.exp(z) / np.exp(z).sum()
    name, score, rejected = model.predict("eine kleine frage")
    assert name == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-12 and rejected == (p.max() < 0.9)


def test_features_go_through_bytes():
    for t in ("eine kleine frage an alle", "", None, "ab " * 5000, "12"):
        for (a, x), (b, y) in zip(langid._read(langid._written(t)), langid.examples(t), strict=True):
            assert (a == b).all() and (x == y).all()
    assert len(langid._written("x" * 3_000_000 + " é" * 100_000)) < 4 * (8 * langid.BUCKETS + 4)


def test_table_edges(spark):
    known = langid.train(["der und das ist"] * 20 + ["the and of is it"] * 20, ["de"] * 20 + ["en"] * 20)
    rows = [(1, "the and of", "x", "own"), (1, "the and of", "x", "own"), (None, None, None, None), (2, "das und ist " * 200_000, "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, other string")
    out = langid.predict(df, known).collect()
    assert [r.lang_pred for r in out] == ["en", "en", "und", "de"] and out[0] == out[1] and [r.other for r in out] == ["own", "own", None, "z"]
    assert langid.predict(df.where("doc_id > 5"), known).columns == ["doc_id", "text", "other", "lang_pred", "score", "rejected"] and langid.predict(df.where("doc_id > 5"), known).count() == 0


def test_fit_on_repeated_rows_is_bounded(spark):
    """One id with more rows than the bound: the driver gets no more than twice the bound."""
    rows = [(3, f"der und die {i}", "de") for i in range(300)] + [(i, "the of and", "en") for i in range(300)] + [(None, "und der", "de"), (9, None, "de"), (10, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.learnt(langid.sample(df, "lang", 10), "lang", langid._written, 20)) <= 20
    model = langid.fit(df, 400)
    assert model.predict("und der die")[0] == "de" and model.predict("of the and")[0] == "en"
    assert langid.fit(df.where("lang = 'none'")).predict("und")[0] == "und"
