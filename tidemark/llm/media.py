"""Media columns: payloads as lossless WebP images, each coded as its own samples ask for, read back and measured.

Images of a batch are laid end to end, and what is worked out for them, copies, transforms, cache hits, tokens and their bits, is worked out
for all at once. Each image takes the transform that an estimate of its size favours, of ``PLANS``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import map_arrow
from .textvec import U64, mix, slices, text_bytes

UNIT = 64
_SIDE = 1 << 14
PLANS = ("plain", "subtract_green", "cross_colour", "left", "up", "palette")
_BLOCK = 9  # one predictor or set of factors for 512 pixels a side
_LITERALS, _LENGTHS, _DISTANCES, _CACHE_MOST, _LONGEST, _CODE_MOST = 256, 24, 40, 9, 4096, 12
#: A colour cache costs time at every pixel: it is used where it saves so much of an image.
_CACHE_WORTH = 0.95
#: So do copies, whose codes take room besides: they are used where literals alone would take more than this times as much.
_PLAIN_WORTH, _CODE_BITS = 1.025, 120
_COPY_BITS, _COLOUR_BITS, _SLOT_BITS, _MARGIN = 22, 36, 5, 64


@dataclass
class _Images:
    """Images end to end: pixels, each pixel's image, bounds and widths."""

    pixels: np.ndarray
    bounds: np.ndarray
    width: np.ndarray

    def __post_init__(self):
        self.n = np.diff(self.bounds)
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    def sums(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.of if where is None else self.of[where], weights=values, minlength=len(self.n))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that symbols with these counts take, over the last axis."""
    term = lambda n: n * np.log2(np.maximum(n, 1))
    return term(counts.sum(axis=-1)) - term(counts).sum(axis=-1)


def _counts(of: np.ndarray, symbols: np.ndarray, images: int, size: int) -> np.ndarray:
    return np.bincount(of * size + symbols, minlength=images * size).reshape(images, size)


def _channel_counts(of: np.ndarray, channels: np.ndarray, images: int) -> np.ndarray:
    """``(image, channel, value)`` counts of pixels ``(n, channels)``."""
    n = channels.shape[1]
    return np.bincount((of[:, None] * (n * 256) + (np.arange(n) * 256)[None, :] + channels).ravel(), minlength=images * n * 256).reshape(images, n, 256)


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    again = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    out = np.full(len(keys), -1, np.int64)
    out[order[again]] = order[again - 1]
    return out


def _copies(images: _Images) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of copies, in order: where three pixels stood before in their image, as far as they go on alike."""
    p, of = images.pixels.astype(U64), images.of
    none = np.zeros(0, np.int64)
    if len(p) < 4:
        return none, none, none
    key = mix(mix(p[:-2] + U64(1)) + mix(p[1:-1] * U64(3) + U64(2)) * U64(5) + p[2:] * U64(0x9E3779B97F4A7C15) + of[:-2].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    key = np.where(of[:-2] == of[2:], key, np.arange(len(key), dtype=U64))  # triples of two images meet no other
    source = _before(key)
    at = np.flatnonzero(source >= 0)
    source = source[at]
    alike = (of[source] == of[at + 2]) & (of[at] == of[at + 2])
    for k in range(3):
        alike &= p[source + k] == p[at + k]
    at, source = at[alike], source[alike]
    if not len(at):
        return none, none, none
    distance = at - source
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (distance[1:] != distance[:-1])
    heads = np.flatnonzero(head)
    found, reach = [], 0
    for begin, end, far in zip(at[heads].tolist(), (at[np.append(heads[1:], len(at)) - 1] + 3).tolist(), distance[heads].tolist()):
        begin = max(begin, reach)
        while end - begin >= 3:
            n = min(end - begin, _LONGEST)
            found.append((begin, n, far))
            begin = reach = begin + n
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (none, none, none)


def _covered(n: int, copies: tuple[np.ndarray, ...]) -> np.ndarray:
    at, length, _ = copies
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _factors(images: _Images, rgba: np.ndarray) -> np.ndarray:
    """``(image, 3)``: what red tells of blue, green of blue and green of red, in 32nds, by least squares."""
    signed = rgba.view(np.int8).astype(float)
    red, green, blue = signed[:, 0], signed[:, 1], signed[:, 2]
    n = np.maximum(images.n, 1)

    def slope(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        mx, my = images.sums(x) / n, images.sums(y) / n
        spread = images.sums(x * x) / n - mx * mx
        return np.clip(np.round(32 * np.where(spread > 1e-9, (images.sums(x * y) / n - mx * my) / np.maximum(spread, 1e-9), 0)), -128, 127)

    green_red, green_blue = slope(red, green), slope(blue, green)
    left = blue - np.floor(green_blue[images.of] * green / 32)
    return np.stack([slope(left, red), green_blue, green_red], axis=1).astype(np.int64)


def _crossed(of: np.ndarray, rgba: np.ndarray, factors: np.ndarray) -> np.ndarray:
    signed = np.ascontiguousarray(rgba).view(np.int8).astype(np.int64)
    f = factors[of]
    out = rgba.copy()
    out[:, 0] = rgba[:, 0] - ((f[:, 2] * signed[:, 1]) >> 5)
    out[:, 2] = rgba[:, 2] - ((f[:, 1] * signed[:, 1]) >> 5) - ((f[:, 0] * signed[:, 0]) >> 5)
    return out


def _guesses(images: _Images, rgba: np.ndarray, at: np.ndarray, up: bool) -> np.ndarray:
    """For pixels ``at`` those to the left, or above them; first rows go by the left, first columns from above."""
    place = at - images.bounds[images.of[at]]
    width = images.width[images.of[at]]
    x, y = place % width, place // width
    above = (y > 0) & (up | (x == 0))
    guess = rgba[np.maximum(at - np.where(above, width, 1), 0)]
    guess[place == 0] = (0, 0, 0, 255)
    return guess


def _without_green(rgba: np.ndarray) -> np.ndarray:
    out = rgba.copy()
    out[:, 0] -= rgba[:, 1]
    out[:, 2] -= rgba[:, 1]
    return out


def _rgba(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]])


def _argb(rgba: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rgba[:, [2, 1, 0, 3]]).view("<u4").ravel().astype(np.uint32)


def _estimates(images: _Images, rgba: np.ndarray, copies: tuple[np.ndarray, ...], factors: np.ndarray) -> np.ndarray:
    """Bits that each image would take by each of ``PLANS``, from the counts of every second or fourth pixel where an image has many."""
    of, size = images.of, len(images.n)
    step = np.where(images.n >= 1024, 4, np.where(images.n >= 512, 2, 1))
    place = np.arange(len(of)) - images.bounds[of]
    taken = place % step[of] == 0 if (step > 1).any() else np.ones(len(of), bool)
    open_ = np.flatnonzero(taken & ~_covered(len(of), copies))
    every = np.flatnonzero(taken)
    copied = _COPY_BITS * np.bincount(of[copies[0]], minlength=size)
    bits = lambda at, values: step[:, None] * _entropy(_channel_counts(of[at], values, size))
    plain = rgba[open_]
    own = bits(open_, plain)
    kept = own[:, 1] + own[:, 3] + copied  # green and alpha are what they are
    out = [own.sum(axis=1) + copied] + [kept + bits(open_, v[:, [0, 2]]).sum(axis=1) for v in (_without_green(plain), _crossed(of[open_], plain, factors))]
    out += [bits(every, rgba[every] - _guesses(images, rgba, every, up)).sum(axis=1) for up in (False, True)]
    colours, index = np.unique((of[open_].astype(U64) << U64(32)) | images.pixels[open_].astype(U64), return_inverse=True)
    owner = (colours >> U64(32)).astype(np.int64)
    number = np.bincount(owner, minlength=size)
    used = np.bincount(index, minlength=len(colours)).astype(float)
    total = np.bincount(owner, weights=used, minlength=size)
    own = total * np.log2(np.maximum(total, 1)) - np.bincount(owner, weights=used * np.log2(np.maximum(used, 1)), minlength=size)
    out.append(np.where(number <= 256, step * own + _COLOUR_BITS * number + copied, np.inf))
    return np.stack(out)


def _planned(images: _Images, copies: tuple[np.ndarray, ...]) -> tuple[_Images, list[tuple[str, np.ndarray | None]], bool, np.ndarray]:
    """The images as their plans make them, each plan's name and parameter, whether copies have other places now, and the estimated bits."""
    rgba, of, size = _rgba(images.pixels), images.of, len(images.n)
    factors = _factors(images, rgba)
    cost = _estimates(images, rgba, copies, factors) + np.array([[0], *[[_MARGIN]] * (len(PLANS) - 1)])
    for d in np.flatnonzero(cost[-1] <= cost[:-1].min(axis=0)):  # a palette must hold every colour, also of pixels that the estimate passes over
        if len(np.unique(images.pixels[images.bounds[d] : images.bounds[d + 1]])) > 256:
            cost[-1, d] = np.inf
    choice = cost.argmin(axis=0)

    plans: list[tuple[str, np.ndarray | None]] = [("plain", None)] * size
    if not choice.any():
        return images, plans, False, cost.min(axis=0)
    pieces, width, moved = [], images.width.copy(), False
    for d in range(size):
        name = PLANS[choice[d]]
        a, b = images.bounds[d], images.bounds[d + 1]
        own = None
        if name == "palette":
            table, index = np.unique(images.pixels[a:b], return_inverse=True)
            own = index.reshape(-1, width[d])
            pack = webp.packing(len(table))
            if pack:
                depth, each = 8 >> pack, 1 << pack
                own = np.pad(own, ((0, 0), (0, -int(width[d]) % each))).reshape(len(own), -1, each)
                own = (own << (np.arange(each) * depth)).sum(axis=2)
                width[d] = own.shape[1]
            pieces.append((own.ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000))
            own, moved = table, moved or bool(pack)
        elif name in ("left", "up"):
            pieces.append(_argb(rgba[a:b] - _guesses(images, rgba, np.arange(a, b), name == "up")))
            moved = True
        elif name == "cross_colour":
            own = factors[d]
            pieces.append(_argb(_crossed(of[a:b], rgba[a:b], factors)))
        else:
            pieces.append(_argb(_without_green(rgba[a:b])) if name == "subtract_green" else images.pixels[a:b])
        plans[d] = (name, own)
    sizes = np.array([len(x) for x in pieces])
    return _Images(np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)]), width), plans, moved, cost.min(axis=0)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, extra values and extra bits of lengths or distances from 1 on."""
    v = values - 1
    top = np.maximum(np.frexp(v.astype(float))[1] - 1, 1)
    extra = np.where(v < 4, 0, top - 1)
    code = np.where(v < 4, v, 2 * top + ((v >> (top - 1)) & 1))
    return code, v & ((1 << extra) - 1), extra


def _named(distance: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distances by the names of near pixels where they have one."""
    out = distance + 120
    for w in np.unique(width):
        names = webp.near_names(int(w))
        near = np.flatnonzero((width == w) & (distance < len(names)))
        out[near] = np.where(names[distance[near]] > 0, names[distance[near]], out[near])
    return out


def encode_images(images: _Images, height: list[int], full: list[int]) -> list[bytes]:
    """A lossless WebP file of each image."""
    copies = _copies(images)
    images, plans, moved, bits_of = _planned(images, copies)
    if moved:
        copies = _copies(images)
    size, of, pixels = len(images.n), images.of, images.pixels
    literals = _rgba(pixels)[:, [1, 0, 2, 3]].astype(np.int64)  # as they are written
    # literals alone, with one code for all channels, where copies and codes of their own save too little
    alike = _counts(np.repeat(of, 4), literals.ravel(), size, 256)
    simple = _entropy(alike) <= _PLAIN_WORTH * (bits_of + _CODE_BITS)
    copies = tuple(x[~simple[of[copies[0]]]] for x in copies)
    open_ = ~_covered(len(of), copies)

    # the colour cache: what stands at a pixel's place is the last pixel before it with the same place, however that was written
    cache_bits = np.clip(np.ceil(np.log2(np.maximum(images.n, 1))).astype(int) - 2, 2, _CACHE_MOST)
    slot = ((pixels.astype(U64) * U64(webp.CACHE_FACTOR)) & U64(0xFFFFFFFF)) >> (32 - cache_bits[of]).astype(U64)
    slot = slot.astype(np.int64)
    last = _before((of << 11) | slot)
    hit = open_ & ~simple[of] & np.where(last >= 0, pixels[np.maximum(last, 0)] == pixels, pixels == 0)
    length, length_extra, length_bits = _prefixes(copies[1])
    stride = _LITERALS + _LENGTHS + (1 << _CACHE_MOST)

    def green_counts(hits: np.ndarray) -> np.ndarray:
        plain = open_ & ~hits
        symbols = np.concatenate([literals[plain, 0], _LITERALS + length, _LITERALS + _LENGTHS + slot[hits]])
        return _counts(np.concatenate([of[plain], of[copies[0]], of[hits]]), symbols, size, stride)

    # a hit saves its pixel's share of the bits and costs its place, the choice between the two and the place's part of the code
    hits, opened = images.sums(hit), images.sums(open_)
    slots = _counts(of[hit], slot[hit], size, 1 << _CACHE_MOST)
    share = np.clip(hits / np.maximum(opened, 1), 1e-9, 1 - 1e-9)
    choosing = -opened * (share * np.log2(share) + (1 - share) * np.log2(1 - share))
    saved = bits_of * share - _entropy(slots) - choosing - _SLOT_BITS * (slots > 0).sum(axis=1)
    cached = saved > (1 - _CACHE_WORTH) * bits_of + 16
    hit &= cached[of]
    greens = green_counts(hit)
    others = _channel_counts(of[open_ & ~hit], literals[open_ & ~hit, 1:], size)
    together = others.sum(axis=1)
    shared = _entropy(together) - _entropy(others).sum(axis=1) < _MARGIN + 0.02 * _entropy(together)
    far, far_extra, far_bits = _prefixes(_named(copies[2], images.width[of[copies[0]]]))
    fars = _counts(of[copies[0]], far, size, _DISTANCES)

    # codes and what comes before the tokens
    green_size, side_size, far_size = np.zeros((size, stride), np.int64), np.zeros((size, 3, 256), np.int64), np.zeros((size, _DISTANCES), np.int64)
    heads: list[webp.BitWriter] = []
    for d in range(size):
        bits = webp.BitWriter()
        bits.write((full[d] - 1) | (height[d] - 1) << 14 | 1 << 28, 32)
        webp.write_plan(bits, plans[d], full[d], height[d], _BLOCK)
        bits.write(0, 1)
        own = _LITERALS + _LENGTHS + (1 << int(cache_bits[d]) if cached[d] else 0)
        bits.write((1 | int(cache_bits[d]) << 1) if cached[d] else 0, 5 if cached[d] else 1)
        bits.write(0, 1)
        if simple[d]:
            part = webp.BitWriter()
            green_size[d, :256] = webp.write_counts(part, alike[d], _CODE_MOST)
            side_size[d] = green_size[d, :256]
            for _ in range(4):
                bits.append(part)
            far_size[d] = webp.write_counts(bits, fars[d], _CODE_MOST)
            heads.append(bits)
            continue
        green_size[d, :own] = webp.write_counts(bits, greens[d, :own], _CODE_MOST)
        if shared[d]:
            part = webp.BitWriter()
            side_size[d] = webp.write_counts(part, together[d], _CODE_MOST)[None, :]
            for _ in range(3):
                bits.append(part)
        else:
            for c in range(3):
                side_size[d, c] = webp.write_counts(bits, others[d, c], _CODE_MOST)
        far_size[d] = webp.write_counts(bits, fars[d], _CODE_MOST)
        heads.append(bits)
    green_size, green_code = webp.canonical_rows(green_size)
    far_size, far_code = webp.canonical_rows(far_size)
    side_size, side_code = (x.reshape(size, 3, 256) for x in webp.canonical_rows(side_size.reshape(-1, 256)))

    # tokens: a literal has four codes, a cache hit one, a copy two with their extra bits
    at = open_.copy()
    at[copies[0]] = True
    place = np.flatnonzero(at)
    token = np.cumsum(at) - 1
    whose = of[place]
    symbol = np.where(hit[place], _LITERALS + _LENGTHS + slot[place], literals[place, 0])
    symbol[token[copies[0]]] = _LITERALS + length
    value, count = green_code[whose, symbol].astype(U64), green_size[whose, symbol]
    plain = np.flatnonzero(open_[place] & ~hit[place])
    for c in range(3):
        s = literals[place[plain], c + 1]
        value[plain] |= side_code[whose[plain], c, s].astype(U64) << count[plain].astype(U64)
        count[plain] += side_size[whose[plain], c, s]
    moved_by = token[copies[0]]
    for v, n in ((length_extra, length_bits), (far_code[of[copies[0]], far], far_size[of[copies[0]], far]), (far_extra, far_bits)):
        value[moved_by] |= v.astype(U64) << count[moved_by].astype(U64)
        count[moved_by] += n
    head = np.array([b.length for b in heads])
    most = np.bincount(whose, weights=count, minlength=size).astype(np.int64)
    words = (head + most) // 32 + 4
    base = np.cumsum(words) - words
    ends = np.cumsum(count)
    begins = np.cumsum(np.bincount(whose, minlength=size))
    first = np.concatenate([[0], ends])[np.concatenate([[0], begins[:-1]])]
    stream = webp.packed_bits(value, 32 * base[whose] + head[whose] + ends - count - first[whose], int(words.sum()))
    out = []
    for d in range(size):
        n = -(-int(head[d] + most[d]) // 8)
        body = np.frombuffer(stream[base[d] : base[d] + words[d]].tobytes()[:n], np.uint8).copy()
        before = np.frombuffer(heads[d].bytes(), np.uint8)
        body[: len(before)] |= before
        out.append(webp.file_of(body.tobytes()))
    return out


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Payloads of positive multiples of 64 bytes as images of 16 or more pixels a row, four bytes a pixel.

    Payloads over a megabyte have wider rows; a last row that isn't full ends in zeros, of which ``load_payload`` is told the number
    by the payload's size.
    """
    if not payloads:
        return []
    pixels = np.array([len(x) // 4 for x in payloads])
    width = 16 * -(-pixels // (16 * _SIDE))
    if width.max() > _SIDE:
        raise ValueError("a payload has at most a gibibyte")
    height = -(-pixels // width)
    bounds = np.concatenate([[0], np.cumsum(width * height)])
    samples = np.zeros(4 * bounds[-1], np.uint8)
    for a, x in zip((4 * bounds).tolist(), payloads):
        samples[a : a + len(x)] = np.frombuffer(x, np.uint8)
    return encode_images(_Images(_argb(samples.reshape(-1, 4)), bounds, width), height.tolist(), width.tolist())


def store_payload(payload: bytes) -> bytes:
    return encode_payloads([payload])[0]


def load_payload(media: bytes, size: int) -> bytes:
    return webp.decode(media).tobytes()[:size]


def media_columns(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id, ``n_bytes`` of its UTF-8 text, ``payload_bytes`` (zeros added up to a positive multiple of 64), ``media``.

    Null and empty texts are 64 zeros; null and repeated ids pass; only the two columns are read. A row's image depends on its text alone.
    """
    kind = dict(df.select(id_col).dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        media, sizes, padded = [], [], []
        for part in slices(batch, 1, rows=128, size=1 << 20):
            data, offsets = text_bytes(part.column(1))
            n = np.diff(offsets)
            whole = np.maximum(-(-n // UNIT) * UNIT, UNIT)
            payloads = [data[a : a + k].tobytes() + b"\0" * int(p - k) for a, k, p in zip(offsets, n, whole)]
            distinct = list(dict.fromkeys(payloads))
            known = dict(zip(distinct, encode_payloads(distinct)))
            media += [known[p] for p in payloads]
            sizes += n.tolist()
            padded += whole.tolist()
        return {"id": batch.column(0), "n_bytes": sizes, "payload_bytes": padded, "media": media}

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, f"id {kind}, n_bytes bigint, payload_bytes bigint, media binary", rows=128).withColumnRenamed("id", id_col)


def read_media(df: DataFrame, *, media_col: str = "media", size_col: str = "payload_bytes") -> DataFrame:
    """``df`` without the media but with ``payload`` as decoded and ``feature``, computed from the samples read back.

    The feature is the samples' mean, standard deviation, entropy in bits and mean step from one to the next. Null media or sizes
    give null for both.
    """
    names = [c for c in df.columns if c not in (media_col, "payload", "feature")]
    kinds = dict(df.dtypes)
    source = df.select(*names, F.col(media_col).alias("media"), F.col(size_col).alias("size"))

    def run(batch: pa.RecordBatch) -> dict:
        payloads, features = [], []
        known: dict[tuple, tuple] = {}
        for media, size in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
            if media is None or size is None:
                payloads.append(None)
                features.append(None)
                continue
            if (media, size) not in known:
                payload = load_payload(media, size)
                known[media, size] = payload, sample_feature(np.frombuffer(payload, np.uint8))
            payload, feature = known[media, size]
            payloads.append(payload)
            features.append(feature)
        return {**{c: batch.column(k) for k, c in enumerate(names)}, "payload": payloads, "feature": features}

    return map_arrow(source, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "payload binary", "feature string"]), rows=128)


def sample_feature(samples: np.ndarray) -> str:
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(samples))
    spread = float(np.sqrt(max((counts * (values - mean) ** 2).sum() / len(samples), 0)))
    step = float(np.abs(np.diff(samples.astype(np.int64))).sum() / max(len(samples) - 1, 1))
    return f"{mean:.4f}|{spread:.4f}|{float(-(share * np.log2(share)).sum()) + 0.0:.4f}|{step:.4f}"


def media_report(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and features of the stored form of ``documents`` and of what is read back from it."""
    stored = media_columns(docs).select("*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    back = read_media(stored)
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
