"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM blocks, resampled PCM.

A media value is a RIFF/WAVE file in a binary column. mu-law and A-law samples are expanded by 256-entry lookup
tables; ADPCM blocks are decoded with numpy, one step at a time across all blocks of a batch; the PCM is resampled
by a fixed polyphase low-pass filter and stored as 16-bit little-endian samples.

Defined results: a null or empty value has no samples (PCM of no bytes, zero features); repeated rows give repeated
rows; an empty table gives an empty table; other columns pass through untouched, so names of the caller's own
columns never clash with ours unless they are the output names asked for (then ours replaces theirs).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MULAW, ALAW, ADPCM = 7, 6, 0x11  # WAVE format tags
RATE = 8000
BLOCK = 576  # bytes of an ADPCM block, header included
#: Samples computed at once, to bound memory.
CHUNK = 1 << 20
#: Bytes of media decoded together.
GROUP = 4 << 20

# Step sizes and index changes of the IMA ADPCM recommendation.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)
    return np.where(u & 0x80, 0x84 - size, size - 0x84).astype("<i2")


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(seg == 0, low + 8, (low + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, size, -size).astype("<i2")


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()


def expand(payload: bytes, tag: int) -> np.ndarray:
    """16-bit samples of G.711 bytes."""
    return (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(payload, np.uint8)]


def decode_adpcm(payload: bytes, block: int = BLOCK) -> np.ndarray:
    """Mono IMA ADPCM: rows are blocks. A block's header holds its first sample (16-bit) and step index; a last,
    short block is read as if it went on with zero nibbles and is cut to its own length afterwards."""
    if not payload:
        return np.zeros(0, "<i2")
    n = -(-len(payload) // block)
    raw = np.zeros(n * block, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    per = 2 * (block - 4) + 1
    out = np.empty((per, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)  # a byte position for all blocks
    at = 1
    for byte in codes:
        for code in (byte & 15, byte >> 4):
            step = IMA_STEPS[index]
            low = (code & 7).astype(np.int32)
            delta = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + IMA_INDEX[low], 0, 88)
            out[at] = value
            at += 1
    last = len(payload) - (n - 1) * block
    return out.T.reshape(-1)[: (n - 1) * per + (2 * max(last - 4, 0) + 1)].astype("<i2")


def encode_adpcm(pcm: np.ndarray, block: int = BLOCK) -> bytes:
    """Blocks that decode_adpcm reads; the last is padded with its last sample."""
    per = 2 * (block - 4) + 1
    if not len(pcm):
        return b""
    n = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1])]).astype(np.int32).reshape(n, per).T
    value = x[0].copy()
    index = np.minimum(np.searchsorted(IMA_STEPS, np.abs(x[1] - x[0])), 88).astype(np.int32)  # the first step fits the first difference
    out = np.zeros((n, block), np.uint8)
    out[:, 2] = index
    out[:, :2] = x[0].astype("<i2").view(np.uint8).reshape(n, 2)
    for i in range(1, per):
        step, diff = IMA_STEPS[index], x[i] - value
        rest, low, delta = np.abs(diff), np.zeros(n, np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            low, rest, delta = low | np.where(hit, bit, 0), rest - np.where(hit, part, 0), delta + np.where(hit, part, 0)
        value = np.clip(np.where(diff < 0, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + IMA_INDEX[low], 0, 88)
        code = (low | np.where(diff < 0, 8, 0)).astype(np.uint8)
        out[:, 4 + (i - 1) // 2] |= code << (4 * ((i - 1) % 2))
    return out.tobytes()


def _taps(up: int, down: int, half: int = 4) -> np.ndarray:
    """Windowed-sinc low-pass filter at the lower of the two rates, one row for each output phase."""
    m = max(up, down)
    t = np.arange(-half * m, half * m + 1)
    h = np.sinc(t / m) * np.hanning(len(t) + 2)[1:-1] * up / m
    rows = np.zeros((up, -(-len(h) // up)))
    for p in range(up):
        part = h[p::up]
        rows[p, : len(part)] = part
    return rows / rows.sum(axis=1, keepdims=True)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Samples at up/down times the rate, ceil(n * up / down) of them; edges are held."""
    n = len(pcm)
    if not n or up == down:
        return pcm.astype("<i2")
    rows = _taps(up, down).astype(np.float32)
    width = rows.shape[1]
    left = width // 2
    x = np.concatenate([np.full(width, pcm[0]), pcm, np.full(width, pcm[-1])]).astype(np.float32)
    out = np.empty(-(-n * up // down), "<i2")
    for phase in range(up):
        # outputs j with (j * down) % up == phase read inputs from (j * down) // up on
        first = next((j for j in range(up) if (j * down) % up == phase), None)
        if first is None or first >= len(out):
            continue
        count = -(-(len(out) - first) // up)
        start = width + (first * down) // up - left
        total = np.zeros(count, np.float32)
        for k in range(width):
            s = start + k
            total += rows[phase, width - 1 - k] * x[s : s + (count - 1) * down + 1 : down]
        out[first::up] = np.clip(np.rint(total), -32768, 32767)
    return out


def wave(payload: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A RIFF/WAVE file around sample bytes; odd payloads get the pad byte that RIFF asks for."""
    bits = 4 if tag == ADPCM else 16 if tag == 1 else 8
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == ADPCM else b"\0\0"
    speed = rate * block // (2 * (block - 4) + 1) if tag == ADPCM else rate * block
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and sample bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE value")
    at, tag, rate, block = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a media value."""
    tag, rate, block, data = unwave(media)
    if tag in (MULAW, ALAW):
        return rate, expand(data, tag)
    if tag == ADPCM:
        return rate, decode_adpcm(data, block)
    if tag == 1:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"unknown format {tag}")


def samples_many(values: list[bytes | None]) -> Iterator[tuple[int, np.ndarray] | None]:
    """samples() of each value in order; ADPCM values of one block size are decoded together, so that each numpy
    step works across the blocks of many values."""
    at, some = 0, 0
    for i, v in enumerate(values):
        some += len(v or b"")
        if some >= GROUP or i == len(values) - 1:
            yield from _group(values[at : i + 1])
            at, some = i + 1, 0


def _group(values: list[bytes | None]) -> Iterator[tuple[int, np.ndarray] | None]:
    parsed = [None if v is None else unwave(v) for v in values]
    together: dict[int, list[int]] = {}
    for i, p in enumerate(parsed):
        if p and p[0] == ADPCM and len(p[3]) % p[2] == 0 and p[3]:
            together.setdefault(p[2], []).append(i)
    pcm: dict[int, np.ndarray] = {}
    for block, members in together.items():
        whole, at, per = decode_adpcm(b"".join(parsed[i][3] for i in members), block), 0, 2 * (block - 4) + 1
        for i in members:
            n = len(parsed[i][3]) // block * per
            pcm[i], at = whole[at : at + n], at + n
    for i, v in enumerate(values):
        yield None if v is None else (parsed[i][1], pcm.pop(i)) if i in pcm else samples(v)


def pcm_pieces(rate: int, pcm: np.ndarray, to_rate: int) -> Iterator[np.ndarray]:
    """Resampled samples, in pieces of bounded size cut at multiples of whole periods. Each piece is computed with the
    samples beside it that the filter reaches, so the pieces together are the whole signal's resample."""
    g = np.gcd(rate, to_rate)
    up, down = int(to_rate // g), int(rate // g)
    step = CHUNK // down * down or down
    # Whole periods of at least the filter's width.
    beside = -(-_taps(up, down).shape[1] // down) * down if up != down else 0
    for i in range(0, len(pcm), step):
        lo, end = max(0, i - beside), min(len(pcm), i + step)
        first = (i - lo) * up // down
        yield resample(pcm[lo : end + beside], up, down)[first : first + -(-(end - i) * up // down)]


def feature(rate: int, pcm: np.ndarray, to_rate: int) -> str:
    """Rate, samples, root mean square, peak, zero crossings and CRC of the resampled PCM."""
    n = peak = cross = crc = 0
    power, before = 0.0, None
    for x in pcm_pieces(rate, pcm, to_rate):
        wide = x.astype(np.int32)
        n += len(x)
        peak = max(peak, int(np.abs(wide).max()))
        power += float(np.dot(x.astype(np.float64), x))
        sign = wide < 0
        cross += int(np.count_nonzero(sign[1:] != sign[:-1])) + (before is not None and bool(sign[0]) != before)
        before = bool(sign[-1])
        crc = zlib.crc32(x.tobytes(), crc)
    return f"rate={to_rate};samples={n};rms={(power / n) ** 0.5 if n else 0.0:.3f};peak={peak};zc={cross};pcm_crc32={crc:08x}"


def _map(df: DataFrame, fields: list[T.StructField], work) -> DataFrame:
    """Append or replace columns computed from each Arrow batch; work(batch) gives a list of arrays."""
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = work(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], names=[*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def store_text_as_media(df: DataFrame, text: str = "text", media: str = "media", unit: int = BLOCK, tags: tuple[int, ...] = (MULAW, ALAW, ADPCM)) -> DataFrame:
    """Each text's UTF-8 bytes, padded by bytes 255 to a positive multiple of unit, as the samples of a WAVE value
    (null text: no bytes before the padding). The codec is tags[CRC-32 of the bytes modulo their number], so equal
    texts are stored alike; ADPCM blocks have unit bytes. Adds n_bytes, the bytes before the padding."""

    def work(b: pa.RecordBatch) -> list:
        out, sizes = [], []
        for s in b.column(text):
            raw = (s.as_py() or "").encode()
            sizes.append(len(raw))
            whole = max(1, -(-len(raw) // unit)) * unit
            tag = tags[zlib.crc32(raw) % len(tags)]
            out.append(wave(raw + b"\xff" * (whole - len(raw)), tag, block=unit if tag == ADPCM else 1))
        return [pa.array(sizes, pa.int64()), pa.array(out, pa.binary())]

    out = _map(df, [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())], work)
    return out.drop(text) if text != media else out


def store_pcm(df: DataFrame, media: str = "media", pcm: str = "pcm", to_rate: int = 16000) -> DataFrame:
    """The resampled PCM of each media value as a binary column (null media: null), to be written as a table. At
    16 kHz, PCM has four bytes for a G.711 sample and eight for an ADPCM byte."""

    def work(b: pa.RecordBatch) -> list:
        found = samples_many([s.as_py() for s in b.column(media)])
        return [pa.array([None if x is None else b"".join(y.tobytes() for y in pcm_pieces(*x, to_rate)) for x in found], pa.binary())]

    return _map(df, [T.StructField(pcm, T.BinaryType())], work)


def describe_media(df: DataFrame, media: str = "media", to_rate: int = 16000) -> DataFrame:
    """Digests of each media value's stored form and payload, and the feature of its resampled PCM, which is that of
    what store_pcm() stores."""
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def work(b: pa.RecordBatch) -> list:
        rows = []
        values = [s.as_py() for s in b.column(media)]
        for v, x in zip(values, samples_many(values)):
            if v is None:
                rows.append((None,) * 6)
                continue
            data = unwave(v)[3]
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(v), hashlib.sha256(v).hexdigest(), feature(*x, to_rate)))
        columns = list(zip(*rows)) if rows else [()] * 6
        return [pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, (_, t) in zip(columns, fields)]

    return _map(df, [T.StructField(n, t) for n, t in fields], work).drop(media)


def op4_media(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = common.stored(spark, store_text_as_media(docs), "media")
    return describe_media(kept).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("media_bytes"), "media_sha256", "feature")
