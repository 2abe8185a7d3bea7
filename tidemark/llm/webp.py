"""Lossless WebP: a decoder for the whole format and an encoder with each of its features.

Pixels are arrays of unsigned 32-bit ``alpha << 24 | red << 16 | green << 8 | blue``, row by row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the format.
_SIGNATURE = 0x2F
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_LITERALS, _LENGTHS, _DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
_PREDICTOR, _CROSS_COLOUR, _SUBTRACT_GREEN, _PALETTE = range(4)
_OPAQUE = 0xFF000000
#: Neighbours named by the distance codes 1 to 120: columns to the left, rows up.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3),
    (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class WebpError(ValueError):
    """The bytes are no lossless WebP image, or a damaged one."""


# Bits


class BitReader:
    """Reads a byte string from its least significant bits on; past the end there are zeros, up to a limit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise WebpError("the image data end too early")
        return value & ((1 << n) - 1)


    def peek(self, n: int, at: int | None = None) -> int:
        at = self.at if at is None else at
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.size, self.parts = 0, 0, []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n
        if self.size >= 1 << 15:
            whole = self.size >> 3
            self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.size -= 8 * whole

    @property
    def length(self) -> int:
        return 8 * sum(map(len, self.parts)) + self.size

    def append(self, other: BitWriter) -> None:
        for part in other.parts:
            self.write(int.from_bytes(part, "little"), 8 * len(part))
        self.write(other.value, other.size)

    def write_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Append many values of up to 60 bits at once: each falls on up to three 32-bit words, whose parts add up."""
        sizes = sizes.astype(np.int64)
        ends = self.size + np.cumsum(sizes)
        if len(ends):
            self.value |= int.from_bytes(packed_bits(values.astype(np.uint64), ends - sizes, int(ends[-1] >> 5) + 4).tobytes(), "little")
            self.size = int(ends[-1])
        self.write(0, 0)

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.size + 7) >> 3, "little")


def packed_bits(values: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """32-bit words with each value of up to 60 bits at its place: it falls on up to three words, whose parts add up."""
    word, shift = starts >> 5, (starts & 31).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    a, b = (values & mask) << shift, (values >> np.uint64(32)) << shift
    out = np.bincount(word, weights=(a & mask).astype(float), minlength=words)
    out += np.bincount(word + 1, weights=((a >> np.uint64(32)) + (b & mask)).astype(float), minlength=words)
    out += np.bincount(word + 2, weights=(b >> np.uint64(32)).astype(float), minlength=words)
    return out.astype("<u8").astype("<u4")


# Prefix codes


@lru_cache(maxsize=16)
def _reversed_bits(n: int) -> np.ndarray:
    """Each value of ``n`` bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class PrefixCode:
    """A canonical prefix code as a table over the next ``bits`` bits: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise WebpError("a prefix code has no symbol")
        if len(used) == 1:
            self.bits, self.symbol, self.length, self.tables = 0, used.astype(np.int32), np.zeros(1, np.int32), {}
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[used]
        self.bits = int(size[-1])
        times = 1 << (self.bits - size)
        if times.sum() != 1 << self.bits:
            raise WebpError("a prefix code is not complete")
        order = _reversed_bits(self.bits)
        self.symbol = np.repeat(used, times).astype(np.int32)[order]
        self.length = np.repeat(size, times).astype(np.int32)[order]
        self.tables: dict[int, list[int]] = {}

    def table(self, place: int) -> list[int]:
        """``symbol << place << 4 | length`` for the next bits."""
        if place not in self.tables:
            self.tables[place] = ((self.symbol.astype(np.int64) << (place + 4)) | self.length).tolist()
        return self.tables[place]

    def read(self, bits: BitReader) -> int:
        if not self.bits:
            return int(self.symbol[0])
        at = bits.at
        i = bits.read(self.bits)
        bits.at = at + int(self.length[i])
        return int(self.symbol[i])


@lru_cache(maxsize=64)
def _prefix_code(lengths: bytes) -> PrefixCode:
    """Codes by their lengths: an image's channels, and a column's images, often share one."""
    return PrefixCode(np.frombuffer(lengths, np.uint8).astype(np.int64))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol, each with its bits in stream order (first bit lowest)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        used = used[np.argsort(lengths[used], kind="stable")]
        top = int(lengths[used[-1]])
        times = 1 << (top - lengths[used])
        codes[used] = _reversed_bits(top)[np.cumsum(times) - times]
    return codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code of at most ``limit`` bits; counts are evened out until it fits. One symbol gets length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].tolist()
    while True:
        depth = _depths(weight)
        if depth[0] <= limit:
            lengths[order] = depth
            return lengths
        weight = [(w + 1) // 2 for w in weight]


def _depths(weight: list[int]) -> list[int]:
    """Depths of a Huffman tree's leaves, whose weights rise: leaves and joined nodes each wait in order, so the two lightest are at the fronts."""
    n = len(weight)
    joined, parent = [], [0] * (2 * n - 1)
    leaf = node = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= k or weight[leaf] <= joined[node]):
                total += weight[leaf]
                parent[leaf] = n + k
                leaf += 1
            else:
                total += joined[node]
                parent[n + node] = n + k
                node += 1
        joined.append(total)
    level = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        level[k] = level[parent[k]] + 1
    return level[:n]


@lru_cache(maxsize=16)
def _meta_code(lengths: int, n: int) -> PrefixCode:
    """The code of codes' lengths, from its own lengths in the order of the format."""
    meta = bytearray(19)
    for k in range(n):
        meta[_LENGTH_ORDER[k]] = lengths >> 3 * k & 7
    return _prefix_code(bytes(meta))


def _read_code(bits: BitReader, size: int) -> tuple[PrefixCode, int]:
    """A code, and the least size of an alphabet for which the same bits give the same code; beyond any, where the alphabet's end ended it."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise WebpError("a symbol exceeds its alphabet")
        lengths[symbols] = 1
        return _prefix_code(lengths.astype(np.uint8).tobytes()), max(symbols) + 1
    n = 4 + bits.read(4)
    code = _meta_code(bits.read(3 * n), n)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    data, first, used = bits.data, bits.at >> 3, bits.at & 7
    mask = (1 << code.bits) - 1
    steps = code.table(0)
    found: list[int] = []
    last, ahead, held = 8, 0, 0
    while len(found) < size and left > 0:
        if held < 14:  # a symbol and its extra bits
            first, used = first + (used >> 3), used & 7
            ahead, held = int.from_bytes(data[first : first + 24], "little") >> used, 192 - used
        left -= 1
        step = steps[ahead & mask]
        n = step & 15
        if step < 256:
            step >>= 4
            found.append(step)
            last = step or last
        else:
            ahead >>= n
            value, least, extra = (last, 3, 2) if step < 272 else (0, 3, 3) if step < 288 else (0, 11, 7)
            found += [value] * (least + (ahead & ((1 << extra) - 1)))
            used += n
            held -= n
            n = extra
        ahead >>= n
        used += n
        held -= n
    if len(found) > size:
        raise WebpError("code lengths run over their alphabet")
    bits.at = 8 * first + used
    bits.read(0)
    return _prefix_code(bytes(found) + bytes(size - len(found))), len(found) if left == 0 else 1 << 30


#: The code in which codes' lengths are written, the same for all: a complete one, fitted to those of prose.
_META = [2, 6, 6, 4, 4, 4, 4, 4, 4, 4, 4, 5, 6, 6, 7, 7, 6, 4, 4]
_META_CODES = canonical(np.array(_META)).tolist()
_META_HEAD = (15 << 1) | sum(_META[s] << (5 + 3 * k) for k, s in enumerate(_LENGTH_ORDER)), 5 + 3 * len(_LENGTH_ORDER)


def _write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        symbols = [int(s) for s in used] or [0]
        bits.write(1, 1)
        bits.write(len(symbols) - 1, 1)
        bits.write(1, 1)
        for s in symbols:
            bits.write(s, 8)
        return
    runs: list[int] = []  # symbol, extra value << 8, extra bits << 16
    plain = lengths[: used[-1] + 1]
    heads = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), len(plain)]
    for value, begin, end in zip(plain[heads[:-1]].tolist(), heads, heads[1:]):
        n = end - begin
        if value:
            runs.append(value)
            n -= 1
            while n >= 3:
                k = min(n, 6)
                runs.append(16 | (k - 3) << 8 | 2 << 16)
                n -= k
        while n >= 3:
            k = min(n, 138)
            runs.append(18 | (k - 11) << 8 | 7 << 16 if k >= 11 else 17 | (k - 3) << 8 | 3 << 16)
            n -= k
        runs += [value] * n
    value, size = _META_HEAD
    if len(runs) < 2:
        runs += [0] * (2 - len(runs))  # past an alphabet's end lengths of 0 say nothing
    width = max(2, (len(runs) - 2).bit_length() + (len(runs) - 2).bit_length() % 2)
    value |= (1 | (width - 2) // 2 << 1 | len(runs) - 2 << 4) << size
    size += 4 + width
    codes, meta = _META_CODES, _META
    for r in runs:
        s = r & 255
        value |= codes[s] << size
        size += meta[s]
        if r > 255:
            value |= (r >> 8 & 255) << size
            size += r >> 16
        if size > 512:
            bits.write(value, size)
            value = size = 0
    bits.write(value, size)


def _read_codes(bits: BitReader, sizes: tuple[int, ...]) -> list[PrefixCode]:
    """The codes of a group. Where the bits of a code come again, for an alphabet that has all of its symbols, so does the code."""
    codes: list[PrefixCode] = []
    begin = end = told = 0
    for n in sizes:
        if codes and told <= n and bits.peek(end - begin) == bits.peek(end - begin, begin):
            bits.at += end - begin
            codes.append(codes[-1])
            continue
        begin = bits.at
        code, told = _read_code(bits, n)
        codes.append(code)
        end = bits.at
    return codes


def write_counts(bits: BitWriter, counts: np.ndarray, limit: int) -> np.ndarray:
    """Write the code of symbols with these counts; returns its lengths."""
    lengths = code_lengths(counts, limit)
    _write_code(bits, lengths)
    return lengths


def canonical_rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`canonical` for each row of ``lengths``: the bits a symbol takes, none where it is its row's only one, and its code."""
    lengths = np.where((lengths > 0).sum(axis=1, keepdims=True) == 1, 0, lengths)
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    ordered = np.take_along_axis(lengths, order, axis=1)
    times = np.where(ordered > 0, 1 << (15 - ordered), 0)
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, np.where(ordered > 0, _reversed_bits(15)[np.minimum(np.cumsum(times, axis=1) - times, 32767)], 0), axis=1)
    return lengths, codes


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and extra bits of a length or distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = (v >> (top - 1)) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def _unprefix(code: int, bits: BitReader) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = _NEAR[code - 1]
    return max(1, dx + dy * width)


@lru_cache(maxsize=64)
def near_names(width: int) -> np.ndarray:
    """By distance, the first of the codes 1 to 120 that names it, or 0."""
    names = np.zeros(8 + 7 * width + 1, np.int64)
    for code in range(len(_NEAR), 0, -1):
        names[_distance(code, width)] = code
    return names


def _cache_index(pixels: np.ndarray, bits: int) -> np.ndarray:
    return ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


# Decoding


class _Canvas:
    """Pixels as they come, with the colour cache brought up to date when it is asked: the plain form of ``_decode_loop``."""

    def __init__(self, n: int, width: int, cache_bits: int):
        self.pixels = np.zeros(n, np.uint32)
        self.n, self.width, self.at = n, width, 0
        self.bits, self.cached = cache_bits, 0
        self.cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None

    def literal(self, value: int) -> None:
        self.pixels[self.at] = value
        self.at += 1

    def from_cache(self, index: int) -> None:
        fresh = self.pixels[self.cached : self.at]
        self.cache[_cache_index(fresh, self.bits)] = fresh  # of equal places the last one stays
        self.cached = self.at
        self.literal(self.cache[index])

    def copy(self, length: int, distance: int) -> None:
        if distance > self.at:
            raise WebpError("a back-reference points before the image")
        length = min(length, self.n - self.at)
        start = self.at - distance
        self.pixels[self.at : self.at + length] = np.resize(self.pixels[start : min(start + length, self.at)], length)
        self.at += length


_WINDOW = 1 << 16


def _windows(data: bytes, first: int) -> list[int]:
    """The 64 bits from each byte on, of ``_WINDOW`` bytes at most; past the end there are zeros."""
    part = np.zeros(min(_WINDOW, max(len(data) - first, 0)) + 24, np.uint8)
    own = np.frombuffer(data[first : first + len(part)], np.uint8)
    part[: len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(part, 8).copy().view("<u8").ravel().tolist()


def _decode_loop(bits: BitReader, n: int, width: int, groups: list[list[PrefixCode]], which: np.ndarray | None, block: int, cache_bits: int) -> np.ndarray:
    """All pixels of an image: one walk along the bits, in which a code's symbol and length are one look at a table.

    Tables hold ``symbol << 4 | length``; those of red and alpha hold the symbol at its place in a pixel. The group of codes changes
    only where a row of pixels enters another block.
    """
    data, first = bits.data, bits.at >> 3
    ahead, limit = _windows(data, first), 8 * _WINDOW
    p, out, i = bits.at - 8 * first, [], 0
    add = out.append
    cache, shift = ([0] * (1 << cache_bits), 32 - cache_bits) if cache_bits else (None, 0)
    across = -(-width // (1 << block)) if which is not None else 0
    switch = 0
    while i < n:
        if i >= switch:
            y, x = divmod(i, width)
            green, red, blue, alpha, far = groups[int(which[(y >> block) * across + (x >> block)]) if which is not None else 0]
            gs, rs, bs, als, fs = green.table(0), red.table(16), blue.table(0), alpha.table(24), far.table(0)
            gm, rm, bm, am, fm = ((1 << c.bits) - 1 for c in (green, red, blue, alpha, far))
            wide = green.bits + red.bits + blue.bits + alpha.bits > 56
            switch = n if which is None else min(i - x + width, i - x + (((x >> block) + 1) << block))
        if p >= limit:
            first, p = first + (p >> 3), p & 7
            if first > len(data) + 8:
                raise WebpError("the image data end too early")
            ahead = _windows(data, first)
        w = ahead[p >> 3] >> (p & 7)
        e = gs[w & gm]
        k = e & 15
        if e < 4096:  # a literal
            p += k
            w >>= k
            r = rs[w & rm]
            k = r & 15
            p += k
            w >>= k
            b = bs[w & bm]
            k = b & 15
            p += k
            w = w >> k if not wide else ahead[p >> 3] >> (p & 7)
            a = als[w & am]
            p += a & 15
            pixel = (e >> 4 << 8) | (r >> 4) | (b >> 4) | (a >> 4)
            add(pixel)
            i += 1
            if cache:
                cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = pixel
            continue
        p += k
        s = (e >> 4) - _LITERALS
        if s >= _LENGTHS:
            pixel = cache[s - _LENGTHS]
            add(pixel)
            i += 1
            cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = pixel
            continue
        w >>= k
        if s >= 4:
            extra = (s - 2) >> 1
            s = ((2 + (s & 1)) << extra) + (w & ((1 << extra) - 1))
            p += extra
            w = ahead[p >> 3] >> (p & 7)
        length = s + 1
        e = fs[w & fm]
        k = e & 15
        p += k
        w >>= k
        s = e >> 4
        if s >= 4:
            extra = (s - 2) >> 1
            s = ((2 + (s & 1)) << extra) + (w & ((1 << extra) - 1))
            p += extra
        distance = _distance(s + 1, width)
        if distance > i:
            raise WebpError("a back-reference points before the image")
        length = min(length, n - i)
        if distance >= length:
            fresh = out[i - distance : i - distance + length]
        else:
            own = out[i - distance :]
            fresh = (own * (length // distance + 1))[:length]
        out += fresh
        i += length
        if cache:
            for pixel in fresh:
                cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = pixel
    bits.at = 8 * first + p
    return np.array(out, np.uint32)


_AT_ONCE = 12


def _decode_alike(bits: BitReader, n: int, code: PrefixCode) -> np.ndarray:
    """Literals only, to the end of the data, with one code for all channels: up to three symbols by one look at a table."""
    ahead_of = np.arange(1 << _AT_ONCE)
    mask = (1 << code.bits) - 1
    symbols, fits, total = np.zeros((len(ahead_of), 3), np.uint8), np.zeros((len(ahead_of), 3), bool), np.zeros(len(ahead_of), np.int64)
    for k in range(3):
        at = (ahead_of >> total) & mask
        size = code.length[at]
        fits[:, k] = (fits[:, k - 1] if k else True) & (total + size <= _AT_ONCE)
        symbols[:, k] = code.symbol[at]
        total += np.where(fits[:, k], size, 0)
    lengths, most = total.astype(np.uint8).tobytes(), (1 << _AT_ONCE) - 1
    data, first = bits.data, bits.at >> 3
    p, out = bits.at - 8 * first, []
    add = out.append
    while first < len(data):
        ahead = _windows(data, first)
        end = min(8 * (len(data) - first), 8 * _WINDOW)
        while p < end:
            w = ahead[p >> 3] >> (p & 7)
            i = w & most
            add(i)
            k = lengths[i]
            w >>= k
            i = w & most
            add(i)
            j = lengths[i]
            w >>= j
            i = w & most
            add(i)
            k += j + lengths[i]
            p += k
        first, p = first + (p >> 3), p & 7
    looked = np.array(out, np.int64)
    values = symbols[looked][fits[looked]]
    if len(values) < 4 * n:
        raise WebpError("the image data end too early")
    green, red, blue, alpha = values[: 4 * n].reshape(-1, 4).astype(np.uint32).T
    bits.at = 8 * len(data)
    return (alpha << np.uint32(24)) | (red << np.uint32(16)) | (green << np.uint32(8)) | blue


def _refer(bits: BitReader, canvas: _Canvas, symbol: int, far: PrefixCode) -> None:
    if symbol >= _LITERALS + _LENGTHS:
        canvas.from_cache(symbol - _LITERALS - _LENGTHS)
        return
    length = _unprefix(symbol - _LITERALS, bits)
    canvas.copy(length, _distance(_unprefix(far.read(bits), bits), canvas.width))


def _decode_by_pixel(bits: BitReader, canvas: _Canvas, groups: list[list[PrefixCode]], which: np.ndarray | None, block: int) -> None:
    """Decode pixel by pixel, with the group of codes that the pixel's block names."""
    across = -(-canvas.width // (1 << block)) if which is not None else 0
    while canvas.at < canvas.n:
        y, x = divmod(canvas.at, canvas.width)
        green, red, blue, alpha, far = groups[int(which[(y >> block) * across + (x >> block)]) if which is not None else 0]
        s = green.read(bits)
        if s >= _LITERALS:
            _refer(bits, canvas, s, far)
            continue
        r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
        canvas.literal(a << 24 | r << 16 | s << 8 | b)


def _decode_image(bits: BitReader, width: int, height: int, *, main: bool = False, by_pixel: bool = False) -> np.ndarray:
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebpError("the colour cache has a wrong size")
    which, block, n_groups = None, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        image = _decode_image(bits, -(-width // (1 << block)), -(-height // (1 << block)))
        which = ((image >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        n_groups = int(which.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    sizes = (_LITERALS + _LENGTHS + cache, 256, 256, 256, _DISTANCES)
    groups = [_read_codes(bits, sizes) for _ in range(n_groups)]
    if by_pixel:
        canvas = _Canvas(width * height, width, cache_bits)
        _decode_by_pixel(bits, canvas, groups, which, block)
        pixels = canvas.pixels
    elif main and which is None and not cache_bits and all(c is groups[0][0] for c in groups[0][:4]) and 0 < groups[0][0].bits <= _AT_ONCE:
        pixels = _decode_alike(bits, width * height, groups[0][0])
    else:
        pixels = _decode_loop(bits, width * height, width, groups, which, block, cache_bits)
    if bits.at > 8 * len(bits.data):
        raise WebpError("the image data end too early")
    return pixels


def decode(data: bytes, *, by_pixel: bool = False) -> np.ndarray:
    """Pixels ``(height, width, 4)`` of red, green, blue and alpha; ``by_pixel`` takes the plain loop throughout."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != _SIGNATURE:
        raise WebpError("no lossless WebP image")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise WebpError("the file is cut short")
    bits = BitReader(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("an unknown version")
    transforms, full = [], width
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform comes twice")
        seen.add(kind)
        if kind in (_PREDICTOR, _CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, block, width, _decode_image(bits, -(-width // (1 << block)), -(-height // (1 << block)), by_pixel=by_pixel)))
        elif kind == _SUBTRACT_GREEN:
            transforms.append((kind, 0, width, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_decode_image(bits, n, 1, by_pixel=by_pixel)), axis=0, dtype=np.uint8)
            pack = packing(n)
            transforms.append((kind, pack, width, table))
            width = -(-width // (1 << pack))
    pixels = _decode_image(bits, width, height, main=True, by_pixel=by_pixel)
    image = _channels(pixels).reshape(height, width, 4)
    for kind, block, wide, extra in reversed(transforms):
        if kind == _PREDICTOR:
            image = _unpredict(image, block, extra)
        elif kind == _CROSS_COLOUR:
            image = _cross(image, block, _channels(extra), 1)
        elif kind == _SUBTRACT_GREEN:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            image = _unpalette(image[..., 1], block, wide, extra)
    assert image.shape[1] == full
    return image


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Red, green, blue, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]])


def packing(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _unpalette(index: np.ndarray, pack: int, width: int, table: np.ndarray) -> np.ndarray:
    if pack:
        depth = 8 >> pack
        index = ((index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint8) * depth)) & ((1 << depth) - 1)).reshape(index.shape[0], -1)[:, :width]
    whole = np.zeros((256, 4), np.uint8)  # beyond the table is transparent black
    whole[: len(table)] = table
    return whole[index]


def _spread(values: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """A value of each block for each of its pixels."""
    across = -(-width // (1 << block))
    return values.reshape(-1, across, *values.shape[1:])[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]


def _cross(image: np.ndarray, block: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take off (-1) what green tells of red, and green and the true red tell of blue."""
    f = _spread(factors, block, image.shape[0], image.shape[1]).view(np.int8).astype(np.int32)
    red_blue, green_blue, green_red = f[..., 0], f[..., 1], f[..., 2]
    part = lambda t, c: (t * c.view(np.int8).astype(np.int32)) >> 5
    out = image.copy()
    green = np.ascontiguousarray(image[..., 1])
    out[..., 0] = image[..., 0] + sign * part(green_red, green)
    red = np.ascontiguousarray(out[..., 0] if sign > 0 else image[..., 0])
    out[..., 2] = image[..., 2] + sign * (part(green_blue, green) + part(red_blue, red))
    return out


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    near_left = np.abs(top - corner).sum(axis=-1, keepdims=True)  # how far the sum of both less the corner is from left
    near_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
    return np.where(near_left < near_top, left, top)


def _guess(mode: int, left, top, right, corner):
    """A predictor's value from the neighbours: left, top, top right, top left (the corner)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = _average(left, top)
        step = middle - corner
        return np.clip(middle + (step + (step < 0)) // 2, 0, 255)  # halves are cut towards zero
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(left))


def _unpredict(image: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    """Undo prediction: by running sums where one mode that looks only left or only up holds throughout, else along fronts of pixels.

    A pixel needs those to its left and, in the row above, up to one to its right; so all pixels with the same ``x + 2 * y`` can be
    done together.
    """
    height, width, _ = image.shape
    named = ((modes >> np.uint32(8)) & np.uint32(15)).astype(np.int64)
    out = image.copy()
    out[:1, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)  # the first row from the left
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)  # the first column from above
    if (named == named[0]).all() and named[0] in (0, 1, 2):
        if named[0] == 1:
            return np.cumsum(out, axis=1, dtype=np.uint8) if height == 1 else np.concatenate([out[:1], np.cumsum(out[1:], axis=1, dtype=np.uint8)])
        if named[0] == 2:
            return np.concatenate([out[:, :1], np.cumsum(out[:, 1:], axis=0, dtype=np.uint8)], axis=1)
        out[1:, 1:, 3] += 255
        return out
    mode = _spread(named, block, height, width)
    flat, mode = out.astype(np.int64).reshape(-1, 4), mode.ravel()
    for front in range(3, width + 2 * height):
        y = np.arange(max(1, (front - width) // 2 + 1), min(height - 1, (front - 1) // 2) + 1)
        i = y * width + front - 2 * y
        if not len(i):
            continue
        for m in np.unique(mode[i]):
            at = i[mode[i] == m]
            flat[at] = (flat[at] + _guess(int(m), flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])) & 255
    return flat.reshape(image.shape).astype(np.uint8)


# Encoding


def _predict(image: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    height, width, _ = image.shape
    mode = _spread(modes, block, height, width)
    flat = image.reshape(-1, 4).astype(np.int64)
    i = np.arange(height * width)
    near = [flat[np.maximum(i - d, 0)] for d in (1, width, max(width - 1, 1), width + 1)]
    if width == 1:
        near[2] = flat[i]
    guess = np.zeros_like(flat)
    for m in np.unique(mode):
        guess[(mode == m).ravel()] = _guess(int(m), *near)[(mode == m).ravel()]
    y, x = np.divmod(i, width)
    guess[x == 0] = near[1][x == 0]
    guess[y == 0] = near[0][y == 0]
    guess[0] = [0, 0, 0, 255]
    return ((flat - guess) & 255).astype(np.uint8).reshape(image.shape)


def _argb(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image.reshape(-1, 4)[:, [2, 1, 0, 3]]).view("<u4").ravel()


def _encode_literals(bits: BitWriter, pixels: np.ndarray) -> None:
    """Literals only, with one code for all four channels: their values are alike in a payload, and one code is built faster."""
    parts = np.ascontiguousarray(_channels(pixels)[:, [1, 0, 2, 3]])
    counts = np.bincount(parts.ravel(), minlength=256)
    lengths = code_lengths(counts, 15)
    code = BitWriter()
    _write_code(code, lengths)  # says nothing of an alphabet's end, so it is the same for each channel
    for _ in range(4):
        bits.write(code.value, code.size)
    _write_code(bits, np.zeros(_DISTANCES, np.int64))
    if np.count_nonzero(counts) == 1:
        return
    codes = canonical(lengths)
    values = codes[parts].astype(np.uint64)
    sizes = lengths[parts]
    total = np.cumsum(sizes, axis=1)
    shift = np.concatenate([np.zeros((len(parts), 1), np.int64), total[:, :-1]], axis=1).astype(np.uint64)
    bits.write_many((values << shift).sum(axis=1, dtype=np.uint64), total[:, -1])


def _tokens(pixels: np.ndarray, width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Literals, cache hits and copies: greedy, the last place with the same three pixels being the source of a copy."""
    plain = pixels.tolist()
    names = {max(1, dx + dy * width): k for k, (dx, dy) in reversed(list(enumerate(_NEAR, 1)))}
    slot = _cache_index(pixels, cache_bits).astype(int).tolist() if cache_bits else None
    cache: dict[int, int] = {}
    last: dict[tuple, int] = {}
    out, at, n = [], 0, len(plain)
    while at < n:
        length, key = 0, tuple(plain[at : at + 3])
        source = last.get(key) if references and len(key) == 3 else None
        if source is not None:
            while at + length < n and length < 4096 and plain[source + length] == plain[at + length]:
                length += 1
        if length >= 3:
            distance = at - source
            out.append(("copy", length, names.get(distance, distance + 120)))
        elif cache_bits and cache.get(slot[at], 0) == plain[at]:
            out.append(("cache", slot[at]))
            length = 1
        else:
            out.append(("literal", plain[at]))
            length = 1
        for i in range(at, at + length):
            last[tuple(plain[i : i + 3])] = i
            if cache_bits:
                cache[slot[i]] = plain[i]
        at += length
    return out


def _encode_image(bits: BitWriter, pixels: np.ndarray, width: int, *, cache_bits: int = 0, references: bool = False, main: bool = False, group_block: int | None = None) -> None:
    bits.write(1 if cache_bits else 0, 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    if main:
        bits.write(0 if group_block is None else 1, 1)
    if not cache_bits and not references and group_block is None:
        _encode_literals(bits, pixels)
        return
    which = lambda at: 0
    n_groups = 1
    if group_block is not None:
        height = len(pixels) // width
        across, down = -(-width // (1 << group_block)), -(-height // (1 << group_block))
        n_groups = min(3, across * down)
        names = np.arange(across * down) % n_groups
        bits.write(group_block - 2, 3)
        _encode_image(bits, (names.astype(np.uint32) << np.uint32(8)) | np.uint32(_OPAQUE), across)
        which = lambda at: int(names[((at // width) >> group_block) * across + ((at % width) >> group_block)])
    sizes = (_LITERALS + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(n_groups)]
    plan, at = [], 0
    for token in _tokens(pixels, width, cache_bits, references):
        g = which(at)
        if token[0] == "literal":
            p = token[1]
            steps = [(0, (p >> 8) & 255, 0, 0), (1, (p >> 16) & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
            at += 1
        elif token[0] == "cache":
            steps = [(0, _LITERALS + _LENGTHS + token[1], 0, 0)]
            at += 1
        else:
            a, b = _prefix(token[1]), _prefix(token[2])
            steps = [(0, _LITERALS + a[0], a[1], a[2]), (4, b[0], b[1], b[2])]
            at += token[1]
        for k, s, _, _ in steps:
            counts[g][k][s] += 1
        plan += [(g, *step) for step in steps]
    lengths = [[code_lengths(c, 15) for c in own] for own in counts]
    for own in lengths:
        for one in own:
            _write_code(bits, one)
    codes = [[canonical(one) for one in own] for own in lengths]
    single = [[np.count_nonzero(one) == 1 for one in own] for own in lengths]
    for g, k, s, extra, n in plan:
        if not single[g][k]:
            bits.write(int(codes[g][k][s]), int(lengths[g][k][s]))
        bits.write(int(extra), n)


def encode(
    image: np.ndarray, *, palette: bool = False, predictor: np.ndarray | None = None, cross_colour: np.ndarray | None = None, subtract_green: bool = False,
    block: int = 2, cache_bits: int = 0, references: bool = False, group_block: int | None = None,
) -> bytes:
    """A lossless WebP file of pixels ``(height, width, 4)``: red, green, blue, alpha.

    Without options it has literals only. ``predictor`` gives a mode, ``cross_colour`` three signed factors (red to blue, green to
    blue, green to red) for each block of ``2**block`` pixels a side; a palette needs at most 256 colours and stands alone.
    """
    height, width, _ = image.shape
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("a side has 1 to 16384 pixels")
    bits = BitWriter()
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(1, 1)
    bits.write(0, 3)
    image = np.ascontiguousarray(image, dtype=np.uint8)
    if palette:
        colours, index = np.unique(image.reshape(-1, 4), axis=0, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has at most 256 colours")
        bits.write(1, 1)
        bits.write(_PALETTE, 2)
        bits.write(len(colours) - 1, 8)
        _encode_image(bits, _argb(np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours))
        pack = packing(len(colours))
        index = index.reshape(height, width)
        if pack:
            depth, each = 8 >> pack, 1 << pack
            index = np.pad(index, ((0, 0), (0, -width % each))).reshape(height, -1, each)
            index = (index << (np.arange(each) * depth)).sum(axis=2)
            width = index.shape[1]
        image = np.zeros((height, width, 4), np.uint8)
        image[..., 1], image[..., 3] = index, 255
    across, down = -(-width // (1 << block)), -(-height // (1 << block))
    if predictor is not None:
        modes = np.broadcast_to(predictor, (across * down,)).astype(np.int64)
        bits.write(1, 1)
        bits.write(_PREDICTOR, 2)
        bits.write(block - 2, 3)
        _encode_image(bits, (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(_OPAQUE), across)
        image = _predict(image, block, modes)
    if cross_colour is not None:
        factors = np.zeros((across * down, 4), np.uint8)
        factors[:, :3] = np.broadcast_to(np.asarray(cross_colour), (across * down, 3)).astype(np.int8).view(np.uint8)
        factors[:, 3] = 255
        bits.write(1, 1)
        bits.write(_CROSS_COLOUR, 2)
        bits.write(block - 2, 3)
        _encode_image(bits, _argb(factors), across)
        image = _cross(image, block, factors, -1)
    if subtract_green:
        bits.write(1, 1)
        bits.write(_SUBTRACT_GREEN, 2)
        image = image.copy()
        image[..., 0] -= image[..., 1]
        image[..., 2] -= image[..., 1]
    bits.write(0, 1)
    _encode_image(bits, _argb(image), width, cache_bits=cache_bits, references=references, main=True, group_block=group_block)
    return file_of(bits.bytes())


def file_of(stream: bytes) -> bytes:
    """The file around an image's bits."""
    body = bytes([_SIGNATURE]) + stream
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def write_plan(bits: BitWriter, plan: tuple[str, np.ndarray | None], width: int, height: int, block: int) -> None:
    """What says that a whole image was transformed: plain, subtract_green, cross_colour with three factors, left, up, or palette with its colours."""
    name, own = plan
    if name == "plain":
        return
    bits.write(1, 1)
    blocks = -(-width // (1 << block)), -(-height // (1 << block))
    if name == "subtract_green":
        bits.write(_SUBTRACT_GREEN, 2)
    elif name == "palette":
        bits.write(_PALETTE, 2)
        bits.write(len(own) - 1, 8)
        _encode_image(bits, _argb(np.diff(_channels(own), axis=0, prepend=np.zeros((1, 4), np.uint8))), len(own))
    elif name == "cross_colour":
        bits.write(_CROSS_COLOUR, 2)
        bits.write(block - 2, 3)
        factors = np.append(own, 255).astype(np.int64).astype(np.uint8)
        _encode_image(bits, _argb(np.broadcast_to(factors, (blocks[0] * blocks[1], 4))), blocks[0])
    else:
        bits.write(_PREDICTOR, 2)
        bits.write(block - 2, 3)
        mode = {"left": 1, "up": 2}[name]
        _encode_image(bits, np.full(blocks[0] * blocks[1], (mode << 8) | _OPAQUE, np.uint32), blocks[0])
