"""Golden values of the byte functions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec, hashing, separators, text
from tidemark.schema import MAX_SEQ


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(data: bytes):
    return F.lit(bytearray(data))


# Vectors of the hash and of CRC-32C.
HASHES = [(b"", 0xBC9F1D34), (b"\x62", 0xEF1345C4), (b"\xc3\x97", 0x5B663814), (b"\xe2\x99\xa5", 0x323C078F), (b"\xe1\x80\xb9\x32", 0xED21633A)]


@pytest.mark.parametrize("data,expected", HASHES)
def test_hash_vectors(spark, data, expected):
    assert one(spark, hashing.hash32(lit(data)))[0] == expected
    assert hashing.hash32_many([data])[0] == expected


def test_hash_forms_agree(spark):
    keys = [bytes((i * 7 + j) % 256 for j in range(i)) for i in range(40)]
    rows = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "i int, k binary").select("i", hashing.hash32("k", 0x12345678).alias("h")).collect()
    assert {r.i: r.h for r in rows} == dict(enumerate(map(int, hashing.hash32_many(keys, 0x12345678))))


CRCS = [(bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C)]


@pytest.mark.parametrize("data,expected", CRCS)
def test_crc_vectors(spark, data, expected):
    crc = hashing.crc32c(lit(data))
    row = one(spark, crc, hashing.crc_mask(crc), hashing.crc_unmask(hashing.crc_mask(crc)))
    assert row[0] == row[2] == expected == hashing.crc32c_bytes(data)
    assert row[1] == hashing.crc_mask_value(expected) != expected
    assert hashing.crc_unmask_value(row[1]) == expected


def test_crc_in_lanes():
    rnd = random.Random(5)
    for n in (1023, 1024, 1025, 1087, 1088, 2048, 4100, 32_761, 70_001):
        data = rnd.randbytes(n)
        crc = 0xFFFFFFFF
        for x in data:
            crc = int(hashing.crc_table()[(crc ^ x) & 255]) ^ (crc >> 8)
        assert hashing.crc32c_bytes(data) == crc ^ 0xFFFFFFFF == hashing.crc32c_bytes(data[700:], hashing.crc32c_bytes(data[:700]))


def test_draws(spark):
    """Draws by number equal draws one after another."""
    from tidemark.functions import draws

    for seed in (301, 0, 2**31 - 1, 2**31 + 5, 1000):
        state, want = draws.first_state(seed), []
        for _ in range(60):
            state = state * 16807 % (2**31 - 1)
            want.append(state)
        i = F.col("id") + 1
        rows = spark.range(30).select("id", draws.draw(i, seed).alias("d"), draws.uniform(i, seed, 10).alias("u"), draws.one_in(i, seed, 3).alias("o"), draws.skewed(i, seed, 6).alias("s")).orderBy("id").collect()
        for r in rows:
            assert (r.d, r.u, r.o) == (want[r.id], want[r.id] % 10, want[r.id] % 3 == 0)
            assert r.s == want[2 * r.id + 1] % (1 << want[2 * r.id] % 7)
    assert one(spark, draws.draw(F.lit(10**9), 7))[0] == 7 * pow(16807, 10**9, 2**31 - 1) % (2**31 - 1)


def test_crc_extends(spark):
    assert hashing.crc32c_bytes(b"world", hashing.crc32c_bytes(b"hello ")) == hashing.crc32c_bytes(b"hello world")
    assert one(spark, hashing.crc32c(lit(b"world"), hashing.crc32c_bytes(b"hello ")))[0] == hashing.crc32c_bytes(b"hello world")


def test_varints(spark):
    values = sorted({v for k in range(63) for v in (2**k - 1, 2**k, 2**k + 1)})
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = rows.select("v", codec.varint("v").alias("e"), codec.varint_length("v").alias("n"), codec.decode_varint(codec.varint("v"))["value"].alias("d")).collect()
    for r in got:
        expected, v = [], r.v
        while v >= 128:
            expected.append(v & 127 | 128)
            v >>= 7
        assert bytes(r.e) == bytes([*expected, v]) and r.n == len(r.e) and r.d == r.v
    top = one(spark, codec.varint(F.lit(-1).cast("long")), codec.decode_varint(codec.varint(F.lit(-1).cast("long")))["value"])
    assert bytes(top[0]) == b"\xff" * 9 + b"\x01" and top[1] == -1


def test_bad_varints_are_null(spark):
    long32, long64 = bytes.fromhex("818283848511"), bytes.fromhex("8182838485818283848511")
    row = one(spark, codec.decode_varint(lit(long32), 32), codec.decode_varint(lit(long64), 64), codec.decode_varint(lit(b"")), codec.decode_varint(lit(b"\x80\x80")))
    assert all(x is None for x in row)


def test_fixed_words(spark):
    row = one(spark, codec.fixed32(F.lit(0x04030201)), codec.fixed64(F.lit(-1).cast("long")), codec.decode_fixed64(codec.fixed64(F.lit(-1).cast("long"))))
    assert bytes(row[0]) == b"\x01\x02\x03\x04" and bytes(row[1]) == b"\xff" * 8 and int(row[2]) == 2**64 - 1


def test_length_prefixed(spark):
    parts = [b"", b"foo", b"bar", b"x" * 200]
    joined = F.concat(*(codec.length_prefixed(lit(p)) for p in parts))
    assert [bytes(x) for x in one(spark, codec.split_length_prefixed(joined))[0]] == parts
    assert one(spark, codec.take_length_prefixed(lit(b"\x05abc")))[0] is None


@pytest.mark.parametrize("key", [b"", b"k", b"hello", b"longggggggggggggggggggggg"])
def test_internal_keys(spark, key):
    for seq in (1, 2, 3, 255, 256, 257, 2**16, 2**32 + 1, MAX_SEQ):
        for op in (0, 1):
            p = one(spark, codec.parse_internal_key(codec.internal_key(lit(key), F.lit(seq), F.lit(op))))[0]
            assert (bytes(p.user_key), p.seq, p.op) == (key, seq, op)
    row = one(spark, codec.parse_internal_key(lit(b"bar")), codec.debug_internal_key(lit(b"")), codec.parse_internal_key(lit(b"x" + b"\x02" + bytes(7))))
    assert row[0] is None and row[1] == "(bad)" and row[2] is None
    assert one(spark, codec.debug_internal_key(codec.internal_key(lit(b'The "key" in \'single quotes\''), F.lit(42), F.lit(1))))[0] == "'The \"key\" in 'single quotes'' @ 42 : 1"


def ik(key, seq, op=1):
    return codec.internal_key(lit(key), F.lit(seq), F.lit(op))


@pytest.mark.parametrize(
    "start,limit,expected",
    [
        ((b"foo", 100), (b"foo", 99), None), ((b"foo", 100), (b"foo", 101), None), ((b"foo", 100), (b"foo", 100), None), ((b"foo", 100), (b"foo", 99, 0), None),
        ((b"foo", 100), (b"bar", 99), None), ((b"foo", 100), (b"hello", 200), (b"g", MAX_SEQ)), ((b"foo", 100), (b"foobar", 200), None), ((b"foobar", 100), (b"foo", 200), None),
    ],
)
def test_separators(spark, start, limit, expected):
    got, want = one(spark, separators.internal_separator(ik(*start), ik(*limit)), ik(*(expected or start)))
    assert bytes(got) == bytes(want)


def test_successors(spark):
    row = one(spark, separators.internal_successor(ik(b"foo", 100)), ik(b"g", MAX_SEQ), separators.internal_successor(ik(b"\xff\xff", 100)), ik(b"\xff\xff", 100), separators.short_successor(lit(b"")))
    assert bytes(row[0]) == bytes(row[1]) and bytes(row[2]) == bytes(row[3]) and bytes(row[4]) == b""
    high = one(spark, separators.shortest_separator(lit(b"a\x81zz"), lit(b"a\x90")), separators.short_successor(lit(b"\xff\x80abc")))
    assert bytes(high[0]) == b"a\x82" and bytes(high[1]) == b"\xff\x81"  # bytes count as unsigned


@pytest.mark.parametrize("number", [0, 1, 9, 10, 12345, 2**64 - 1, 2**64 - 2, 2**64 - 100])
def test_decimal_accepted(spark, number):
    for pad in ("", "pad"):
        got = one(spark, text.take_decimal(F.lit(f"{number}{pad}")))[0]
        assert int(got.value) == number and got.rest == pad


@pytest.mark.parametrize("bad", [str(2**64), "99999999999999999999", "184467440737095516150", "", " ", "a", " 123", "a123", "\x00123", "\x7f123"])
def test_decimal_rejected(spark, bad):
    assert one(spark, text.take_decimal(F.lit(bad)))[0] is None


def test_escape_and_status(spark):
    row = one(spark, text.escape_bytes(lit(b"a\\b\x00\x7f\xff ~")), text.escape_bytes(lit(b"")), text.status_text(F.lit("not_found"), F.lit("m"), F.lit("d")), text.status_text(F.lit("ok"), F.lit("m")))
    assert list(row) == ["a\\b\\x00\\x7f\\xff ~", "", "NotFound: m: d", "OK"]


def test_varints_look_at_their_data_once(spark):
    data = F.col("id").cast("string").cast("binary")
    for made in (codec.decode_varint(data), codec.take_length_prefixed(data), codec.varint(F.col("id") * 3)):
        plan = spark.range(1).select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert plan.count("id#") == 1
