import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media, webp


def images():
    rng = np.random.default_rng(3)
    yield rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    yield np.zeros((1, 1, 4), np.uint8)
    yield np.full((4, 16, 4), 7, np.uint8)
    yield rng.integers(0, 3, (20, 33, 4), dtype=np.uint8) * 9
    slope = (np.add.outer(np.arange(30), np.arange(21)) % 256).astype(np.uint8)
    yield np.stack([slope, slope + 3, slope * 2, np.full_like(slope, 255)], axis=2)
    yield np.repeat(rng.integers(0, 256, (3, 1, 4), dtype=np.uint8), 40, axis=1)


OPTIONS = [
    {}, {"subtract_green": True}, {"cross_colour": (5, -30, 77)}, {"cache_bits": 4}, {"references": True}, {"references": True, "cache_bits": 6}, {"group_block": 2},
    {"group_block": 3, "references": True, "cache_bits": 2}, {"predictor": 11, "cross_colour": (1, 2, 3), "subtract_green": True, "cache_bits": 3, "references": True},
    *({"predictor": m} for m in range(14)), {"palette": True}, {"palette": True, "references": True, "cache_bits": 2},
]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_round_trip_both_ways(options):
    for image in images():
        if options.get("palette") and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
            continue
        data = webp.encode(image, **options)
        assert (webp.decode(data) == image).all() and (webp.decode(data, by_pixel=True) == image).all()


def test_a_known_file():
    """A two by two image spelt by hand, bit by bit: simple codes and the subtract-green transform."""
    bits = webp.BitWriter()
    for value, n in ((1, 14), (1, 14), (1, 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    for symbols in ((10, 20), (1,), (2,), (255,), (0,)):  # green, red, blue, alpha, distance
        for value, n in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)):
            bits.write(value, n)
    for bit in (0, 1, 1, 0):
        bits.write(bit, 1)
    body = b"\x2f" + bits.bytes()
    body += b"\0" * (len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).reshape(-1, 4).tolist() == [[11, 10, 12, 255], [21, 20, 22, 255], [21, 20, 22, 255], [11, 10, 12, 255]]


def test_damage_is_an_error():
    data = webp.encode(np.random.default_rng(1).integers(0, 256, (9, 9, 4), dtype=np.uint8))
    for bad in (b"", b"RIFF", data[:40], data[:12] + b"VP8 " + data[16:], data[:20] + b"\x30" + data[21:]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)


def test_distance_names_are_distinct():
    assert len(set(webp._NEAR)) == len(webp._NEAR) == 120


def test_large_and_tiny_payloads():
    for payload in (bytes(64), b"ab" * 32, bytes(range(256)) * 5000, b"\xff" * 128):
        assert media.load_payload(media.store_payload(payload), len(payload)) == payload


def ascii_image(rng, n, make):
    """Text of ``n`` pixels of four ASCII characters, ``make`` giving each from those before it."""
    pixels = []
    for i in range(n):
        pixels.append([int(v) for v in make(pixels, i)])
    return "".join(chr(v) for p in pixels for v in p)


def telling_texts():
    """A text for each plan: few groups of characters, rising and falling ones, rows like those above, channels that tell of others."""
    rng = np.random.default_rng(8)
    step = lambda p: np.clip(np.array(p) + rng.integers(-1, 2, 4), 33, 126)
    fresh = lambda: rng.integers(33, 127, 4)
    few = rng.integers(33, 127, (40, 4))
    return {
        "plain": ascii_image(rng, 700, lambda p, i: fresh()),
        "palette": ascii_image(rng, 3000, lambda p, i: few[rng.integers(40)]),
        "palette of six": ascii_image(rng, 3000, lambda p, i: few[rng.integers(6)]),
        "left": ascii_image(rng, 3000, lambda p, i: step(p[-1]) if p else fresh()),
        "up": ascii_image(rng, 3008, lambda p, i: step(p[i - 16]) if i >= 16 else fresh()),
        "subtract_green": ascii_image(rng, 3000, lambda p, i: (lambda c: (c, c, c, rng.integers(33, 127)))(rng.integers(33, 127))),
        "cross_colour": ascii_image(rng, 3000, lambda p, i: (lambda g: (40 + g // 2, g, 90 - g // 4, rng.integers(33, 127)))(rng.integers(33, 127))),
    }


def test_each_feature_is_used_and_read_back(monkeypatch):
    """What the query stores is decoded through each transform, back-references and the colour cache, and as the plain loop has it."""
    ran = set()

    def spy(name):
        real = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, **k: (ran.add(name), real(*a, **k))[1])

    for name in ("_unpredict", "_cross", "_unpalette", "_distance"):
        spy(name)
    loop = webp._decode_loop
    monkeypatch.setattr(webp, "_decode_loop", lambda *a: (ran.add(f"cache {a[-1] > 0}"), loop(*a))[1])
    plans = []
    planned = media._planned
    monkeypatch.setattr(media, "_planned", lambda *a: (plans.append(planned(*a)), plans[-1])[1])
    wanted = {"plain": set(), "palette": {"_unpalette"}, "palette of six": {"_unpalette"}, "left": {"_unpredict"}, "up": {"_unpredict"}, "subtract_green": set(), "cross_colour": {"_cross"}}
    payloads = {k: t.encode() + bytes(-len(t) % 64) for k, t in telling_texts().items()}
    together = media.encode_payloads(list(payloads.values()))
    for (name, payload), stored in zip(payloads.items(), together):
        ran.clear()
        assert media.store_payload(payload) == stored  # whatever it is encoded with
        assert plans[-1][1][0][0] == name.split(" ")[0]
        assert media.load_payload(stored, len(payload)) == payload and wanted[name] <= ran, name
        assert webp.decode(stored, by_pixel=True).tobytes()[: len(payload)] == payload
        assert len(stored) < (1 if name == "plain" else 0.75) * len(payload)
    prose = (" ".join(f"of the {w} and the {w} that is in the {w}" for w in "one two three four five six seven eight".split() * 4)).encode()
    ran.clear()
    stored = media.store_payload(prose + bytes(-len(prose) % 64))
    assert media.load_payload(stored, len(prose)) == prose and {"_distance", "cache True"} <= ran and len(stored) < len(prose) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=400), st.builds(lambda a, n: a * n, st.binary(min_size=1, max_size=9), st.integers(1, 900))), min_size=1, max_size=4))
def test_any_payloads(parts):
    payloads = [p + bytes(max(64, -(-len(p) // 64) * 64) - len(p)) for p in parts]
    for payload, stored in zip(payloads, media.encode_payloads(payloads)):
        assert media.load_payload(stored, len(payload)) == payload == webp.decode(stored, by_pixel=True).tobytes()[: len(payload)]


def test_payload_edges():
    rng = np.random.default_rng(0)
    assert media.encode_payloads([]) == []
    for payload in (bytes(64), bytes(64 * 4096), rng.bytes(64 * 300), b"abcd" * 70_000, rng.bytes(1 << 20) + bytes(64), b"ab" * 32, b"\xff" * 128):
        assert media.load_payload(media.store_payload(payload), len(payload)) == payload


def test_mixed_predictors():
    """Modes that differ from block to block, decoded along fronts."""
    rng = np.random.default_rng(4)
    for h, w in ((1, 9), (9, 1), (13, 17), (30, 8), (2, 40)):
        image = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
        modes = rng.integers(0, 14, (-(-h // 4)) * (-(-w // 4)))
        assert (webp.decode(webp.encode(image, predictor=modes)) == image).all(), (h, w)


def test_report(small):
    got = {r.doc_id: r for r in media.media_report(small).collect()}
    for r in small.collect():
        raw = r.text.encode()
        payload = raw + bytes(max(-(-len(raw) // 64) * 64, 64) - len(raw))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x.media_bytes < len(payload) + 600
