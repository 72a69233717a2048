"""Token ids equal the library's plain call for any file and across block borders."""

import json

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from filemeta.llm import word_tokens
from filemeta.llm.word_tokens import WordTokens

WORDS = P.path("word_bpe_49k.json")
TEXTS = ["a <|endoftext|> b", "plain words here", None, "", "<|startoftext|>", "<|endoftext|><|endoftext|> x  y", "Ünïcode Straße ǅ ſ don't STOP 12 漢字", "end. " * 50]


def plain(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_the_plain_calls():
    tokens = WordTokens(WORDS)
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(TEXTS)]
    assert tokens.by_chunk and got == plain(Tokenizer.from_file(WORDS), TEXTS) and got[0] == [320, 49407, 321]


@pytest.mark.parametrize("change", [lambda s: s["normalizer"]["normalizers"].pop(), lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True), lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s.update(normalizer=None)])
def test_other_files_go_to_the_library_whole(tmp_path, change):
    spec = json.load(open(WORDS))
    change(spec)
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    tokens = WordTokens(path)
    assert not tokens.by_chunk
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(TEXTS)] == plain(Tokenizer.from_file(path), TEXTS)


@pytest.mark.parametrize("block, cache", [(10, 5), (60, 10**6), (10**6, 2)])
def test_blocks_and_caches_change_nothing(monkeypatch, block, cache):
    monkeypatch.setattr(word_tokens, "BLOCK", block)
    monkeypatch.setattr(word_tokens, "CACHE", cache)
    monkeypatch.setattr(word_tokens, "TOGETHER", 2)
    tokens, library = WordTokens(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(TEXTS)] == plain(library, TEXTS)
