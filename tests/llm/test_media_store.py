"""Media columns against slow versions: WAVE values byte by byte, the resampler's sums, the feature from stored PCM."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from filemeta.llm import media

FIELDS = re.compile(r"rate=(\d+);samples=(\d+);rms=([\d.]+);peak=(\d+);zc=(\d+);pcm_crc32=([0-9a-f]{8})")


def slow_resample(pcm, up, down):
    """Each output by its own sum over the inputs around it; edges are held."""
    rows = media._taps(up, down)
    width, out = rows.shape[1], []
    for j in range(-(-len(pcm) * up // down)):
        at, phase = divmod(j * down, up)
        total = sum(rows[phase][width - 1 - k] * pcm[min(max(at - width // 2 + k, 0), len(pcm) - 1)] for k in range(width))
        out.append(int(np.clip(np.rint(total), -32768, 32767)))
    return out


@pytest.mark.parametrize("up, down", [(2, 1), (1, 2), (3, 2), (2, 3), (147, 80)])
def test_resample_equals_the_slow_sum(up, down):
    pcm = np.random.default_rng(up).integers(-20000, 20000, 90).astype("<i2")
    got = media.resample(pcm, up, down).astype(int)
    assert len(got) == -(-90 * up // down) and np.abs(got - slow_resample(pcm, up, down)).max() <= 1  # float32 sums


def test_filter_passes_a_constant_and_keeps_a_tone():
    assert (media.resample(np.full(50, 1234, "<i2"), 2, 1) == 1234).all() and (media.resample(np.full(50, -7, "<i2"), 3, 2) == -7).all()


def slow_wave(raw, tag):
    """The bytes of a RIFF/WAVE value, field by field."""
    payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    block, bits, more = (576, 4, struct.pack("<HH", 2, 1145)) if tag == 0x11 else (1, 8, struct.pack("<H", 0))
    rate = 8000 * block // 1145 if tag == 0x11 else 8000
    head = struct.pack("<HHIIHH", tag, 1, 8000, rate, block, bits) + more
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


TEXTS = ["", None, "a", "b" * 576, "c" * 577, "é漢 " * 300, "long " * 60_000, "b" * 576, "d", "e", "f", "g"]


def test_query_equals_slow_digests_and_stored_pcm(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in media.op4_media(spark, folder).collect()}
    kept = media.store_pcm(media.store_text_as_media(spark.read.parquet(f"{folder}/documents.parquet"), "text"), "media")
    kept.write.parquet(f"{folder}/pcm.parquet")
    back = {r.doc_id: r for r in spark.read.parquet(f"{folder}/pcm.parquet").collect()}
    tags = set()
    for i, t in enumerate(TEXTS):
        raw, r = (t or "").encode(), rows[i]
        tag = (7, 6, 0x11)[zlib.crc32(raw) % 3]
        tags.add(tag)
        want = slow_wave(raw, tag)
        assert bytes(back[i].media) == want and (r.media_bytes, r.media_sha256) == (len(want), hashlib.sha256(want).hexdigest())
        pcm = np.frombuffer(back[i].pcm, "<i2")
        rate, n, rms, peak, crossings, crc = FIELDS.fullmatch(r.feature).groups()
        assert (int(rate), int(n), int(peak)) == (16000, len(pcm), int(np.abs(pcm.astype(int)).max()))
        assert int(crossings) == int(np.count_nonzero(np.diff(pcm < 0))) and int(crc, 16) == zlib.crc32(back[i].pcm)
        assert abs(float(rms) - np.sqrt(np.mean(pcm.astype(float) ** 2))) < 0.01
        assert len(pcm) == 2 * (r.payload_bytes if tag != 0x11 else r.payload_bytes // 576 * 1145)
    assert len(tags) == 3 and rows[3].feature == rows[7].feature


def test_small_pieces_and_groups_change_nothing(monkeypatch):
    values = [slow_wave(("x y z %d " % k * 90 * k).encode(), (7, 6, 0x11)[k % 3]) for k in range(9)] + [None]
    whole = [None if x is None else media.feature(*x, 16000) for x in media.samples_many(values)]
    monkeypatch.setattr(media, "CHUNK", 97)
    monkeypatch.setattr(media, "GROUP", 700)
    small = [None if x is None else media.feature(*x, 16000) for x in media.samples_many(values)]
    assert small == whole


def test_table_edges(spark):
    df = spark.createDataFrame([(1, "a", "own", "pcm")], "doc_id long, text string, media string, n_bytes string")
    out = media.store_text_as_media(df)
    assert out.columns == ["doc_id", "n_bytes", "media"] and media.store_text_as_media(df.where("doc_id > 3")).count() == 0
    assert media.describe_media(out.where("doc_id > 3")).count() == 0 and media.store_pcm(out).columns == ["doc_id", "n_bytes", "media", "pcm"]
