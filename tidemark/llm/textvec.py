"""Words of whole Arrow text columns as NumPy arrays of hashes: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at once; the tables of powers that each worker keeps are 16 times as long.
_BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
#: Every ASCII character that is neither letter nor digit.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; no word spans two rows."""
    inside = ~separators[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: np.uint64) -> np.ndarray:
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(_BASE_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap. Long inputs go block by block."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        size = _BLOCK if hi - lo <= _BLOCK else hi - lo
        power, inverse = _powers(size + 1)
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + U64(seed))
        at = to
    return out


def word_hashes(column: pa.Array, separators: np.ndarray = SPACES, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    data, offsets = text_bytes(column)
    starts, ends, rows = words(data, offsets, separators)
    return hash_spans(lower[data], starts, ends), rows


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of a row, bounds of the rows in them. A row of fewer words has its whole sequence as one."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    step = U64(0xD6E8FEB86659FD93)
    size = len(hashes)
    acc = np.zeros(max(size - n + 1, 0), dtype=U64)
    for k in range(n):
        acc = acc * step + hashes[k : size - n + 1 + k] if len(acc) else acc
    whole = rows[: len(acc)] == rows[n - 1 :] if len(acc) else np.zeros(0, bool)
    acc, owner = mix(acc + U64(n))[whole], rows[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        for i, r in enumerate(short):
            h = 0
            for w in hashes[first[r] : first[r + 1]].tolist():
                h = (h * int(step) + w) & 0xFFFFFFFFFFFFFFFF
            extra[i] = mix(np.array([h], dtype=U64) + U64(count[r]))[0]
        acc, owner = np.concatenate([acc, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        acc, owner = acc[order], owner[order]
    return acc, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))]).astype(np.int64)


def slices(batch: pa.RecordBatch, text: int, rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and, but for single rows, about ``size`` bytes of text column number ``text``."""
    column = batch.column(text).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
