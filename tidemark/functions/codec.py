"""Byte codecs as column expressions: fixed and variable-length integers, length-prefixed bytes, versioned keys.

Integers are BIGINT; a word of 64 bits that has its top bit set is negative there. Where the full unsigned range matters, decoders
give DECIMAL(20,0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELETE, PUT
from .text import escape_bytes, let

_HEX = "hex"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_bytes(text: Column) -> Column:
    return F.to_binary(text, F.lit(_HEX))


def _reversed_pairs(text: Column, n: int) -> Column:
    return F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))))


def byte_at(data: Column | str, i: Column | int) -> Column:
    """Byte number ``i`` from 0 as a number; a byte is a character of its own number in Latin-1."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.ascii(F.decode(F.substring(_column(data), i + 1, F.lit(1)), "ISO-8859-1")).cast("long")


def little_endian(data: Column, n: int) -> Column:
    """The number that the first ``n`` bytes, at most seven, make, least significant first; missing bytes count as 0."""
    latin = F.decode(F.substring(data, F.lit(1), F.lit(n)), "ISO-8859-1")
    parts = [F.shiftleft(F.ascii(F.substring(latin, F.lit(i + 1), F.lit(1))).cast("long"), 8 * i) for i in range(n)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fixed32(v: Column | str) -> Column:
    """Four bytes, least significant first; ``v`` in 0..2**32-1."""
    return hex_bytes(_reversed_pairs(F.lpad(F.hex(_column(v).cast("long")), 8, "0"), 4))


def fixed64(v: Column | str) -> Column:
    """Eight bytes, least significant first."""
    return hex_bytes(_reversed_pairs(F.lpad(F.hex(_column(v).cast("long")), 16, "0"), 8))


def decode_fixed32(data: Column | str) -> Column:
    return little_endian(_column(data), 4)


def decode_fixed64(data: Column | str) -> Column:
    """DECIMAL(20,0), so that the unsigned range fits."""
    return F.conv(_reversed_pairs(F.hex(F.substring(_column(data), 1, 8)), 8), 16, 10).cast("decimal(20,0)")


def _shift_right(v: Column, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", v, F.lit(n) if isinstance(n, int) else n)


def varint_length(v: Column | str) -> Column:
    """Bytes of ``v`` as a varint: one for each seven bits, at least one; ten for a 64-bit word with its top bit set."""
    v = _column(v).cast("long")
    length = F.when(v < 0, 10)
    for k in range(1, 9):
        length = length.when(v < (1 << 7 * k), k)
    return length.otherwise(9).cast("long")


def varint(v: Column | str) -> Column:
    """Seven bits a byte, least significant first, the top bit set on all bytes but the last. Also of 32-bit values."""
    return let(_column(v).cast("long"), _varint)


def _varint(v: Column) -> Column:
    def byte(i: int) -> Column:
        more = F.when(_shift_right(v, 7 * i + 7) != 0, 128).otherwise(0) if i < 9 else F.lit(0)
        return _shift_right(v, 7 * i).bitwiseAND(127).bitwiseOR(more)

    head = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(byte(i), 56 - 8 * i) for i in range(8)))
    tail = F.shiftleft(byte(8), 8).bitwiseOR(byte(9))
    digits = F.concat(F.lpad(F.hex(head), 16, "0"), F.lpad(F.hex(tail), 4, "0"))
    return hex_bytes(F.substring(digits, F.lit(1), varint_length(v).cast("int") * 2))


def decode_varint(data: Column | str, bits: int = 64) -> Column:
    """``struct(value, size)`` of the varint at the start, or null where it is cut short or longer than ``bits`` allow (5 or 10 bytes)."""
    most = 5 if bits == 32 else 10
    latin = F.decode(F.substring(_column(data), F.lit(1), F.lit(most)), "ISO-8859-1")  # a character for each byte

    def value(whole: Column) -> Column:
        parts = (F.shiftleft(F.ascii(F.substring(whole, i + 1, 1)).cast("long").bitwiseAND(127), 7 * i) for i in range(most))  # what is past the end counts as 0
        total = reduce(lambda a, b: a.bitwiseOR(b), parts)
        total = total.bitwiseAND(0xFFFFFFFF) if bits == 32 else total
        return F.when(whole != "", F.struct(total.alias("value"), F.length(whole).cast("long").alias("size")))

    return let(F.regexp_extract(latin, "\\A[\\x80-\\xff]*[\\x00-\\x7f]", 0), value)


def length_prefixed(data: Column | str) -> Column:
    return F.concat(varint(F.length(_column(data))), _column(data))


def take_length_prefixed(data: Column | str) -> Column:
    """``struct(value, rest)``: the first length-prefixed bytes and what follows, or null where they are cut short."""

    def taken(data: Column, head: Column) -> Column:
        start = head["size"].cast("int")
        size = head["value"]  # up to 2**32-1
        return F.when(
            head.isNotNull() & (F.length(data) >= start + size),
            F.struct(F.substring(data, start + 1, size.cast("int")).alias("value"), F.substring(data, start + size.cast("int") + 1, F.length(data)).alias("rest")),
        )

    return let(_column(data), lambda d: let(decode_varint(d, 32), lambda head: taken(d, head)))


def split_length_prefixed(data: Column | str) -> Column:
    """All length-prefixed byte strings that lie one after another in ``data``; what is cut short at the end is left out."""
    data = _column(data)
    start = F.struct(data.alias("rest"), F.array().cast("array<binary>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        def after(got: Column) -> Column:  # nothing is left to take where what is left is cut short
            return F.when(got.isNull(), F.struct(F.lit(b"").alias("rest"), state["found"].alias("found"))).otherwise(
                F.struct(got["rest"].alias("rest"), F.concat(state["found"], F.array(got["value"])).alias("found"))
            )

        return F.when(F.length(state["rest"]) > 0, let(take_length_prefixed(state["rest"]), after)).otherwise(state)

    turns = F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1)))
    return F.aggregate(turns, start, step, lambda s: s["found"])


def pack_version(seq: Column | str, op: Column | str) -> Column:
    """``seq << 8 | op``. Signed from 2**55 on: for packing, not for ordering."""
    return F.shiftleft(_column(seq).cast("long"), 8).bitwiseOR(_column(op).cast("long"))


def internal_key(key: Column | str, seq: Column | str, op: Column | str) -> Column:
    """The key's bytes, then the version word."""
    return F.concat(_column(key).cast("binary"), fixed64(pack_version(seq, op)))


def user_key(data: Column | str) -> Column:
    """All but the last eight bytes, or null where there are fewer."""
    data = _column(data)
    return F.when(F.length(data) >= 8, F.substring(data, F.lit(1), F.length(data) - 8))


def parse_internal_key(data: Column | str) -> Column:
    """``struct(user_key, seq, op)``, or null for fewer than eight bytes or an unknown operation."""
    data = _column(data)
    op = byte_at(data, F.length(data) - 8).cast("int")
    seq = little_endian(F.substring(data, F.length(data) - 6, F.lit(7)), 7)
    return F.when((F.length(data) >= 8) & op.isin(DELETE, PUT), F.struct(user_key(data).alias("user_key"), seq.alias("seq"), op.alias("op")))


def lookup_key(key: Column | str, snapshot: Column | str) -> Column:
    """What a packed store seeks to read ``key`` at ``snapshot``: the internal key of a put, with its length before it."""
    return length_prefixed(internal_key(key, snapshot, F.lit(PUT)))


def entry(key: Column | str, seq: Column | str, op: Column | str, value: Column | str) -> Column:
    """A whole version: the internal key and the value, each with its length before it."""
    return F.concat(length_prefixed(internal_key(key, seq, op)), length_prefixed(_column(value)))


def debug_version(key: Column | str, seq: Column | str, op: Column | str) -> Column:
    return F.concat(F.lit("'"), escape_bytes(_column(key).cast("binary")), F.lit("' @ "), _column(seq).cast("string"), F.lit(" : "), _column(op).cast("string"))


def debug_internal_key(data: Column | str) -> Column:
    """As :func:`debug_version`, or ``(bad)`` and the escaped bytes where they don't parse."""
    p = parse_internal_key(data)
    return F.when(p.isNotNull(), debug_version(p["user_key"], p["seq"], p["op"])).otherwise(F.concat(F.lit("(bad)"), escape_bytes(_column(data))))
