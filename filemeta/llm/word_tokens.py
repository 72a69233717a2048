"""Token ids of whole texts by the tokenizers library, each distinct word once.

A tokenizer file with the normalizer and pre-tokenizer below, which never look across white space, gives a text the
ids of its chunks (runs between ASCII white space) in a row. Arrow kernels find the distinct chunks of a block of
texts, cut ASCII punctuation from behind a letter (the file's pattern splits there) and lower ASCII letters (its
normalizer does); the library gets each distinct part once, and numpy puts the ids of all texts together. A worker
keeps parts it has seen up to a bound. A text that holds the string of an added token (as <|endoftext|>), and any
text where the file is another, goes to the library whole, so every text has the ids of the library's plain call.
"""

from __future__ import annotations

import json
import os
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker keeps; beyond, only those of the last block stay, which has all frequent ones.
CACHE = 300_000
#: Bytes, and rows, of text that are looked up together; they bound a worker's memory.
BLOCK, ROWS = 8 << 20, 2000
#: Words that go through the library in one text.
TOGETHER = 2000
#: ASCII punctuation that may be cut off behind a letter: no apostrophe, which begins contractions.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# The normalizer and pre-tokenizer of files that are cut in chunks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LOADED: dict[str, "WordTokens"] = {}


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level files: printable bytes for themselves, the others counted up
    from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + i for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _list(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # in parts, as lowering can make an added token's string of another
        self.cache: dict[str, bytes] = {}
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.by_chunk = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["type"] == "BPE"
        added = spec["added_tokens"] or []
        self.by_chunk &= not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.added = [t["content"] for t in added]

    def _ask(self, word: str) -> bytes:
        """The library's model on a word of Latin-1 letters, which normalizing leaves but for case."""
        low = word if word.isascii() else word.lower().encode().decode("latin-1").translate(_LETTERS)
        return pack(f"<{len(found := self.model.tokenize(low))}I", *[t.id for t in found])

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _learn(self, new: list[str]) -> None:
        """Cache what the library gives for parts. Words of Latin-1 letters, which the normalizer leaves but for case
        and the pre-tokenizer whole, go straight to its model; other words of letters go through the library many at a
        time, told apart by their pre-token numbers; should a word have come to several pre-tokens, each goes alone."""
        plain = [c for c in new if c.isalpha()]
        rest = [c for c in new if not c.isalpha()]
        simple = [c for c in plain if max(c) <= "\xff" and (not c.isascii() or c.islower())]
        self.cache.update([(c, self._ask(c)) for c in simple])
        plain = [c for c in plain if c not in self.cache]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            numbers = np.array(found.word_ids, np.int64)
            cuts = (np.flatnonzero(np.diff(numbers)) + 1) * 4
            if len(cuts) + 1 != len(some):
                rest += some
                continue
            data, cuts = np.array(found.ids, "<u4").tobytes(), cuts.tolist()
            self.cache.update(zip(some, [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])]))
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for c, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers (null: none)."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = np.full(len(column), not self.by_chunk)
        for token in self.added if self.by_chunk else []:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if whole.any():
            self.library.encode_special_tokens = False
            found = {i: np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes() for i in np.flatnonzero(whole).tolist()}
            self.library.encode_special_tokens = True
            out = self._chunked(pc.if_else(pa.array(whole), "", column)) if self.by_chunk else [b""] * len(column)
            return [found.get(i, x) for i, x in enumerate(out)]
        return self._chunked(column)

    def _chunked(self, column: pa.Array) -> list[bytes]:
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[bytes] = []
        while len(out) < len(column):
            at = len(out)
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")) - at)
            out += self._block(column.slice(at, n))
        return out

    def _block(self, column: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(column)
        offsets = np.asarray(lists.offsets, np.int64)
        chunks = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        distinct = chunks.dictionary
        bare = pc.ascii_rtrim(distinct, characters=TAIL)
        bare = pc.if_else(pc.match_substring_regex(bare, "[A-Za-z]$"), bare, distinct)
        whole, cut = _list(distinct), _list(pc.utf8_length(bare))
        rest = pa.array([c[n:] for c, n in zip(whole, cut)], distinct.type)
        words, tails = pc.ascii_lower(bare).dictionary_encode(), rest.dictionary_encode()
        number = np.stack([words.indices.to_numpy(), tails.indices.to_numpy() + len(words.dictionary)], axis=1)
        parts = _list(words.dictionary) + _list(tails.dictionary)
        self.cache[""] = b""
        get = self.cache.get
        known = list(map(get, parts))
        if None in known:
            self._learn(list({p for p, k in zip(parts, known) if k is None}))
            known = list(map(get, parts))
        if len(self.cache) > CACHE:
            self.cache = dict(zip(parts, known))
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        # First the ids of each distinct chunk, then of each text.
        ids, ends = _gather(ids, size, number.reshape(-1))
        size = np.diff(ends[::2])
        ids, ends = _gather(ids, size, chunks.indices.to_numpy())
        data, cuts = ids.tobytes(), (ends[offsets - offsets[0]].astype(np.int64) * 4).tolist()
        return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def _gather(ids: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, size long each, put in an order; the runs' bounds in the result."""
    start = np.cumsum(size, dtype=np.int32) - size
    lengths = size[order]
    ends = np.zeros(len(order) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    take = np.repeat(start[order] - ends[:-1], lengths)
    take += np.arange(len(take), dtype=np.int32)
    return ids[take], ends
