"""Long signals are resampled in pieces."""

import numpy as np
import pytest

from filemeta.llm import media


@pytest.mark.parametrize("rates", [(8000, 16000), (16000, 8000), (8000, 12000), (44100, 16000), (8000, 8000)])
@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 4321])
def test_pieces_equal_one_whole_resample(monkeypatch, rates, n):
    monkeypatch.setattr(media, "CHUNK", 500)
    pcm = np.random.default_rng(n).integers(-32768, 32768, n).astype("<i2")
    g = int(np.gcd(*rates))
    whole = media.resample(pcm, rates[1] // g, rates[0] // g)
    got = list(media.pcm_pieces(rates[0], pcm, rates[1]))
    assert len(got) == -(-n // max(500 // (rates[0] // g) * (rates[0] // g), rates[0] // g)) and (np.concatenate([*got, whole[:0]]) == whole).all()


def test_a_value_longer_than_a_piece():
    pcm = media.expand(np.random.default_rng(1).bytes((1 << 20) + 5000), media.MULAW)
    assert (np.concatenate(list(media.pcm_pieces(8000, pcm, 16000))) == media.resample(pcm, 2, 1)).all()
