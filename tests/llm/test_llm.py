"""Operators of the llm subpackage against libraries and brute force, and their defined edge cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filemeta.llm import byte_bpe, common, components, fingerprint, html_extract, huffman, langid, line_dedup, media, near_dedup, packing, quality, queries
from filemeta.llm.word_tokens import WordTokens
from tests.oracle import differences

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "a", "é", "a" * 5000, "x y " * 3000, "\n\n", "😀\x00\x1c b", "don't STOP!!! ok. ok.", "ŠÇ İ ſ Σς ﬁ", "a  b\t\tc\r\n", "  ", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>"]
ALPHABET = st.sampled_from(["a", "B", "th", "e", " ", "\n", "1", "'s", "'LL", "é", "́", "漢", "😀", "\x85", "\xa0", "\x1c", ".", ",", "$$", "ing", "İ", "Σ", " ", "<|endoftext|>", "<|STARTOFTEXT|>"])
TEXT = st.lists(ALPHABET, max_size=60).map("".join)


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


def folder(spark, tmp_path, texts, labels=None):
    df = docs(spark, texts, lang="en", source="s").withColumn("n_chars", F.length("text").cast("long"))
    df.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


# --- tokens ---------------------------------------------------------------------------------------------------


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


LIBRARY = _library()


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_tokens_equal_the_library(text):
    assert np.frombuffer(WordTokens.of(WORDS).encode([text])[0], "<u4").tolist() == ids_of(text)


def _tiktoken():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TIK = _tiktoken()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe_equals_tiktoken(text):
    bpe = byte_bpe.ByteBPE.of(RANKS, P.PATTERN)
    ids = np.frombuffer(bpe.encode(text), "<u4")
    assert ids.tolist() == TIK.encode_ordinary(text) and bpe.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthenig", min_size=60, max_size=600), st.data())
def test_byte_bpe_join_is_a_monoid(piece, data):
    bpe = byte_bpe.ByteBPE.of(RANKS, P.PATTERN)
    b = piece.encode()
    i = data.draw(st.integers(0, len(b)))
    j = data.draw(st.integers(i, len(b)))
    x, y, z = (bpe.merge(p) for p in (b[:i], b[i:j], b[j:]))
    assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z)) == bpe.merge(b) == bpe.encode_piece(b)
    assert bpe.join(x, []) == x == bpe.join([], x)


def test_op7_on_odd_texts(spark, tmp_path):
    rows = {r.doc_id: r for r in byte_bpe.op7_byte_bpe(spark, folder(spark, tmp_path, ODD)).collect()}
    for i, t in enumerate(ODD):
        ids = TIK.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


# --- packing --------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(1, 64))
def test_fill_finds_the_best_sum(counts, capacity):
    taken = packing.fill(counts, capacity)
    assert all(n <= counts[k] for k, n in taken.items())
    lengths = list(itertools.chain.from_iterable([k] * n for k, n in counts.items()))
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)


def check_packing(rows, texts, capacity=4096, end=2):
    whole = {i: ids_of(t) + [end] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
    assert set(by_doc) == set(whole)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(whole[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_op1_packs_every_id_once_without_padding(spark):
    rows = packing.op1_packing(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_packing(rows, texts) == 0


def test_op1_on_odd_texts(spark, tmp_path):
    assert check_packing(packing.op1_packing(spark, folder(spark, tmp_path, ODD)).collect(), dict(enumerate(ODD))) == 0
    assert packing.op1_packing(spark, folder(spark, tmp_path, [])).count() == 0


# --- token files ----------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(0, 2**32))
def test_huffman_codes(counts, seed):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 10)
    used = np.flatnonzero(counts)
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= 10
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
    if len(used):
        ids = np.random.default_rng(seed).choice(used, 1000).astype("<u2")
        bits, marks = huffman.encode_bits(ids, huffman.canonical(lengths), lengths)
        tokens = np.minimum(huffman.STRIDE, len(ids) - np.arange(len(marks)) * huffman.STRIDE)
        assert huffman.decode_block(np.frombuffer(bits, np.uint8), marks, tokens, huffman.lookup(lengths)).tolist() == ids.tolist()


def test_huffman_is_optimal_without_a_binding_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45])
    heap = [(int(c), 0) for c in counts]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        best += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 0))
    assert int((counts * huffman.code_lengths(counts)).sum()) == best


@pytest.mark.parametrize("texts", [ODD, [], None])
def test_op9_reads_back_what_it_wrote(spark, tmp_path, texts):
    sf = SMALL if texts is None else folder(spark, tmp_path, texts)
    rows = sorted(huffman.op9_token_files(spark, sf).collect(), key=lambda r: r.doc_id)
    source = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(rows, source, strict=True):
        ids = ids_of(d.text) + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op9_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (3, "b"), (3, "c c"), (1, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = huffman.op9_token_files(spark, f"file://{tmp_path}").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0), (True, 1), (True, 3), (True, 3)]
    assert sorted(r.start for r in rows)[0] == 0 and {r.start for r in rows if r.doc_id is None} == {0}


# --- near duplicates --------------------------------------------------------------------------------------------


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    inside, root = {}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in inside.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            inside[x].append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op2_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_groups(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op2_near_dedup(spark, SF).collect()}
    assert got == want


def test_near_duplicates_in_chains_and_hot_groups(spark, monkeypatch):
    """A chain of edits whose ends are unlike, a big group of near copies, near misses; small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts, now = [], list(base)
    for _ in range(40):
        now = list(now)
        now[int(rng.integers(0, 120))] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(now))
    for _ in range(80):
        y = list(base)
        for _ in range(int(rng.integers(1, 9))):
            y[int(rng.integers(0, 120))] = f"m{rng.integers(0, 10**6)}"
        texts.append(" ".join(y))
    texts += ["", None, " \n", "One", "one", "one two", "ONE two"] + [texts[0]] * 5
    for size, percent in ((5, 80), (3, 85)):
        want = brute_groups(list(enumerate(texts)), size, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts, rep="x", comp=1), size, percent).collect()}
        assert got == want
    kept = near_dedup.near_duplicates(docs(spark, ["a b c", "a b c", None])).where("kept").count()
    assert kept == 2 and near_dedup.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        found = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64)
            n = int(400 * share)
            a = np.unique(np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2, dtype=np.uint64)]))
            b = np.unique(np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2, dtype=np.uint64)]))
            found.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        assert abs(np.mean(found) - share) < 0.02


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(200, 200)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark, spark.createDataFrame(links * 2, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


# --- line dedup --------------------------------------------------------------------------------------------------


def test_op5_matches_sql(spark):
    assert differences(spark, SF, line_dedup.op5_line_dedup, line_dedup.ORACLE_SQL) == ""


def test_op5_has_no_python(spark):
    plan = line_dedup.op5_line_dedup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_edges(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc", "q\nq\nq\nq", None, "", "a\nb", "\n\n\n", "\n\n\n", "b\nc\nd"]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts, n_removed="old", pos=1, h1=2)).collect()}
    assert [rows[i].text for i in range(9)] == ["a\nb\nc\nd", "x", "q", None, "", "a\nb", "\n\n\n", "\n\n\n", ""]
    assert [rows[i].n_removed for i in range(9)] == [0, 3, 3, 0, 0, 0, 0, 0, 3] and rows[0].pos == 1
    twice = docs(spark, ["a\nb\nc"]).unionByName(docs(spark, ["a\nb\nc"]))
    assert [r.n_removed for r in line_dedup.dedup_lines(twice).collect()] == [0, 0]
    assert line_dedup.dedup_lines(docs(spark, []).limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(null).collect()} == {None: 0, 1: 3}


# --- pages -------------------------------------------------------------------------------------------------------


def test_op3_gives_whole_articles(spark):
    import html

    got = {r.page_id: r for r in html_extract.op3_html_extract(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner)]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


LONG = "It was the best of the times for all of us and it was not the worst that we had in the years before. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<script>x<p>y</p></script>", ""),
        (f"<body><div class='menu'><a href=a>Home</a> <a href=b>More</a></div><p>{LONG}</p><p>Short.</p><div id=comments><p>{LONG}</p></div><footer>{LONG}</footer></body>", LONG.strip() + "\n\nShort."),
        (f"<header>{LONG}</header><aside>{LONG}</aside><form>{LONG}</form><div class='cookie-notice'>{LONG}</div><p>{LONG}</p>", LONG.strip()),
        (f"<div>{LONG}</div><article><h1>T &amp; U</h1><p>One&nbsp;two <b>three</b><br>four<p>%%% &lt;x&gt;</article>", "T & U\n\nOne two three four\n\n%%% <x>"),
        (f"<p>{LONG}</p><ul><li><a href=x>One link</a><li><a href=y>Two link</a></ul><p>{LONG}</p>", LONG.strip() + "\n\n" + LONG.strip()),
        ("<main><p title='a > b'>Kept</p><!-- <p>no</p> --><style>p{}</style><textarea>no</textarea></main>", "Kept"),
        ("<article>a<nav>b</nav>c<div hidden>d</div></article>", "a\n\nc"), ("<article><p>open <script>no", "open"),
    ],
)
def test_extraction_cases(page, want):
    assert html_extract.main_text(page) == want


# --- media -------------------------------------------------------------------------------------------------------


def test_g711_tables():
    """Brute force: the expansions by their definitions, sample by sample."""
    for code in range(256):
        u = ~code & 255
        size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
        assert media.MULAW_PCM[code] == (-size if u & 128 else size)
        a = code ^ 0x55
        seg, low = a >> 4 & 7, a & 15
        size = (low << 4) + 8 if seg == 0 else ((low << 4) + 264) << (seg - 1)
        assert media.ALAW_PCM[code] == (size if a & 128 else -size)


def slow_adpcm(block):
    value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(media.IMA_INDEX[code & 7])))
            out.append(value)
    return out


@settings(max_examples=20, deadline=None)
@given(st.binary(min_size=576, max_size=576), st.integers(1, 4))
def test_adpcm_equals_the_slow_decoder(block, times):
    assert media.decode_adpcm(block * times).tolist() == slow_adpcm(block) * times


def test_adpcm_round_trip_and_resampling():
    tone = (8000 * np.sin(np.arange(4000) * 0.05)).astype("<i2")
    back = media.decode_adpcm(media.encode_adpcm(tone))[: len(tone)]
    assert np.abs(back.astype(int) - tone)[50:].max() < 800
    up = media.resample(tone, 2, 1)
    want = 8000 * np.sin(np.arange(8000) * 0.025)
    assert len(up) == 8000 and np.abs(up - want)[50:-50].max() < 200
    assert len(media.resample(tone, 1, 2)) == 2000 and len(media.resample(tone, 3, 2)) == 6000 and len(media.resample(tone[:0], 2, 1)) == 0
    for tag, block in ((media.MULAW, 1), (media.ALAW, 1), (media.ADPCM, 576), (1, 2)):
        assert media.unwave(media.wave(b"\x01" * 577, tag, block=block)) == (tag, 8000, block, b"\x01" * 577)


def test_op4(spark, tmp_path):
    texts = ODD + ODD[5:8]
    rows = {r.doc_id: r for r in media.op4_media(spark, folder(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[5].feature == rows[len(ODD)].feature and rows[5].media_sha256 == rows[len(ODD)].media_sha256
    pcm = media.store_pcm(media.store_text_as_media(docs(spark, ["ab"], pcm="old"))).first().pcm
    assert len(pcm) % 2 == 0 and len(pcm) >= 2 * 576
    assert media.describe_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().feature is None


# --- language, quality -------------------------------------------------------------------------------------------


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op6_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.op6_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98 and np.mean([r.rejected for r in held]) < 0.02


def test_language_edges(spark, tmp_path):
    rows = langid.op6_language_id(spark, folder(spark, tmp_path, ["the one", "...", None, "", "12 34"])).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {0: "en", 1: "und", 2: "und", 3: "und", 4: "und"}
    assert langid.op6_language_id(spark, folder(spark, tmp_path, [])).count() == 0
    known = langid.train(["der und das ist"] * 20 + ["the and of is it"] * 20, ["de"] * 20 + ["en"] * 20)
    assert known.predict("das und der")[0] == "de" and known.predict("漢字 漢字")[1] <= 1
    out = langid.predict(docs(spark, ["the and"], score=3, rejected="x"), known).first()
    assert out.lang_pred == "en" and out.rejected is False


def auc(score, good):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def test_op8_held_out_quality(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op8_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    good = np.array([label[r.doc_id] == 1 for r in held])
    score = np.array([r.score for r in held])
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == _held(r.doc_id) for r in rows)
    assert auc(score, good) > 0.95 and (score[good] >= 0.7).mean() > 0.95


def test_quality_edges(spark, tmp_path):
    assert {r.score for r in quality.op8_quality(spark, folder(spark, tmp_path, ["a", None, ""])).collect()} == {0.5}
    assert {r.predicted for r in quality.op8_quality(spark, folder(spark, tmp_path, ["a", "b"], [(1, 1, 0)])).collect()} == {1}
    model = quality.train(["good text here"] * 30 + ["x$$$ y%%%"] * 30, [1] * 30 + [0] * 30)
    assert model.score("more good text") > 0.5 > model.score("z$$$ w%%%") and 0 <= model.score(None) == model.score("") <= 1


# --- fingerprints ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé \t", max_size=30), max_size=8), st.randoms())
def test_fingerprint_is_a_multiset_hash(paragraphs, rng):
    v = fingerprint.vector("\n".join(paragraphs))
    mixed = list(paragraphs)
    rng.shuffle(mixed)
    assert (fingerprint.vector("\n".join(mixed)) == v).all()
    more = fingerprint.combine(v, fingerprint.vector("new one"))
    assert (more == fingerprint.vector("\n".join([*paragraphs, "new one"]))).all()
    assert (fingerprint.combine(more, fingerprint.vector("new one"), -1) == v).all()
    assert (fingerprint.decode(fingerprint.encode(v)) == v).all()


def test_fingerprint_sketch_equals_a_slow_one():
    text = "ab\n\ncdefghijkl é"
    out = np.zeros(fingerprint.SKETCH, int)
    for p in text.encode().split(b"\n"):
        for i in range(len(p)):
            w = int.from_bytes(p[i : i + 8].ljust(8, b"\0"), "little")
            h = w * int(fingerprint._MIX[0]) % 2**64
            h = (h ^ h >> 29) * int(fingerprint._MIX[1]) % 2**64 >> 40
            out[(h >> 1) * fingerprint.SKETCH >> 23] += -1 if h & 1 else 1
    assert fingerprint.sketch_of(fingerprint.vector(text)).tolist() == out.tolist()


@pytest.mark.parametrize("texts", [ODD, ["only one"], [], None])
def test_op10(spark, tmp_path, texts):
    sf = SMALL if texts is None else folder(spark, tmp_path, texts)
    source = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in fingerprint.op10_fingerprint(spark, sf).collect()}
    assert len(rows) == len(source)
    for d, e in zip(source, source[1:] + source[:1]):
        a, b, r = d.text or "", e.text or "", rows[d.doc_id]
        n = len(a) // 4
        new = a[: len(a) - n] + b[:n]
        va, vb, vn = (fingerprint.vector(x) for x in (a, b, new))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(new.encode()).hexdigest(), fingerprint.encode(va), fingerprint.encode(vn))
        assert r.near_edited == fingerprint.likeness(va, vn) and r.near_next == fingerprint.likeness(va, vb)
    if texts is None:
        assert np.mean([r.near_edited for r in rows.values()]) > 0.6 > 0.3 > np.mean([r.near_next for r in rows.values()])


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    """Each stage against a brute-force version of its decision on what the stage before kept."""
    import corpus_pipeline as cp

    now, names = common.table(spark, SMALL, "documents"), [n for n, _ in cp.STAGES]
    assert names == ["language_id", "quality", "line_dedup", "near_dedup", "packing"]
    columns = now.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, SMALL)
        if name != "packing":
            assert out.columns == columns
            now = common.stored(spark, out, name)
            after = {r.doc_id: r for r in now.collect()}
            assert set(after) <= set(before)
        if name == "language_id":
            m = langid.fit(common.table(spark, SMALL, "documents"))
            assert set(after) == {i for i, r in before.items() if not m.predict(r.text)[2]}
        elif name == "quality":
            m = quality.fit(spark.createDataFrame(list(before.values())), common.table(spark, SMALL, "labels"))
            assert set(after) == {i for i, r in before.items() if m.score(r.text) >= quality.GOOD}
        elif name == "line_dedup":
            want = brute_lines({i: r.text for i, r in before.items()})
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t.strip(" ") or t == before[i].text}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            groups = brute_groups([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        else:
            assert check_packing(out.collect(), {i: r.text for i, r in before.items()}) == 0


def brute_lines(texts):
    first, gone = {}, {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" ") and first.setdefault(w, (i, k)) != (i, k):
                gone.setdefault(i, set()).update((k, k + 1, k + 2))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in texts.items()}


def test_queries_are_registered():
    import __spark_entry__ as e

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())
    assert isinstance(pa.__version__, str)
