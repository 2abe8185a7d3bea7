"""Token ids of whole Arrow text columns by a byte-level BPE tokenizer file, each distinct word being encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textvec import U64, hash_spans, text_bytes

TOKENIZER = "byte_bpe_50k"
_BLANK, _SPACE, _LETTER, _DIGIT, _MARK, _HIGH = range(6)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[128:] = _HIGH
    out[9:14], out[32] = _SPACE, _BLANK
    for first, last, kind in (("a", "z", _LETTER), ("A", "Z", _LETTER), ("0", "9", _DIGIT)):
        out[ord(first) : ord(last) + 1] = kind
    return out


_CLASS = _byte_classes()
#: White space outside ASCII: what the tokenizer does with the white space around it is not looked into here.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in the bytes of texts, without white space outside ASCII, at which the tokenizer parts what it then encodes by itself.

    These are contractions; ASCII words, numbers and runs of marks, each with the one blank before it; other runs without white space,
    which are not parted further; white space up to the last character before a run. Every text begins a stretch.
    """
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first, last = first[:-1], first[1:].copy()
    last[-1:] = True
    space = kind <= _SPACE
    before, after = np.roll(space, 1), np.roll(space, -1)
    begin = first | (space & ~before) | (space & ~after & ~last)
    run = ~space & (before | first)  # a run without white space begins
    begin |= run & (np.roll(kind, 1) != _BLANK)
    number = np.cumsum(run)
    mixed = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
    mixed[number[kind == _HIGH]] = True
    plain = ~space & ~mixed[number]
    begin |= plain & ~run & (kind != np.roll(kind, 1))
    # an apostrophe that begins a stretch takes s, t, m, d, re, ve or ll with it
    text = np.concatenate([data, np.zeros(3, np.uint8)])
    own = np.flatnonzero(begin & plain & (data == ord("'")) & ~last)
    one, two = text[own + 1], text[own + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    whole = np.cumsum(first)
    inside = (own + 2 < len(data)) & (whole[np.minimum(own + 2, len(data) - 1)] == whole[own])
    pair = inside & np.isin(one.astype(np.int64) * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    for places, size in ((own[single], 2), (own[pair], 3)):
        begin[places + 1] = False
        ends = places + size
        ends = ends[ends < len(data)]
        begin[ends[plain[ends]]] = True
    return np.flatnonzero(begin)


class BpeTokenizer:
    """Encodes columns: stretches are told apart by 64-bit hashes, and the tokenizer gets those it has not met.

    The ids of short stretches are kept, at most ``most`` of them; then they are forgotten and met again. Texts that hold a token of the
    file's own, like ``<|endoftext|>``, or white space outside ASCII are encoded whole.
    """

    def __init__(self, name: str = TOKENIZER, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.own = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.full.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Take up ``hashes``, sorted and new, of ``texts``."""
        got = self._whole(texts)
        sizes = np.array([len(x) for x in got], np.int64)
        place = np.searchsorted(self.hashes, hashes)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, *got])
        self.hashes, self.starts, self.sizes = (np.insert(a, place, b) for a, b in ((self.hashes, hashes), (self.starts, starts), (self.sizes, sizes)))

    def _by_stretch(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(column)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(column)
        full = np.flatnonzero(np.diff(offsets) > 0)
        cuts = stretches(data, offsets[full])
        ends = np.append(cuts[1:], len(data))
        distinct, at, which = np.unique(hash_spans(data, cuts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        fresh = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(fresh):
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[a:b].decode() for a, b in zip(cuts[at[fresh]].tolist(), ends[at[fresh]].tolist())])
        place = np.searchsorted(self.hashes, distinct)[which]
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[np.searchsorted(cuts, offsets)]
        if len(self.hashes) > self.most or len(self.ids) > 8 * self.most:
            self.forget()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row; null is empty."""
        texts = column.fill_null("").to_pylist()
        rare = [i for i, t in enumerate(texts) if any(own in t for own in self.own) or not t.isascii() and _WIDE_SPACE.search(t)]
        if not rare:
            return self._by_stretch(column)
        common = np.setdiff1d(np.arange(len(texts)), rare)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for where, got in ((common, self._by_stretch(column.take(pa.array(common)))), (rare, self._whole([texts[i] for i in rare]))):
            for i, ids in zip(where, got):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def bpe_tokenizer(name: str = TOKENIZER) -> BpeTokenizer:
    """One tokenizer for each Python worker, from task to task."""
    return BpeTokenizer(name)
