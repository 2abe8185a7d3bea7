"""Short keys between keys, by unsigned bytes: what an index needs in place of whole keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_SEQ, PUT
from .codec import byte_at, fixed64, hex_bytes, pack_version, parse_internal_key


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cut_and_raise(data: Column, i: Column) -> Column:
    """The bytes up to byte ``i`` from 0, that byte one larger."""
    return F.concat(F.substring(data, F.lit(1), i), hex_bytes(F.lpad(F.hex(byte_at(data, i) + 1), 2, "0")))


def shortest_separator(start: Column | str, limit: Column | str) -> Column:
    """A short key in [start, limit): cut after the first byte that differs, raised by one, if it then is still below ``limit``'s; else ``start``."""
    start, limit = _column(start), _column(limit)
    n = F.least(F.length(start), F.length(limit))
    differ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(start, i, F.lit(1)) != F.substring(limit, i, F.lit(1)))
    i = (F.array_position(differ, True) - 1).cast("int")
    fit = (n > 0) & (i >= 0) & (byte_at(start, i) + 1 < byte_at(limit, i))
    return F.when(fit, _cut_and_raise(start, i)).otherwise(start)


def short_successor(key: Column | str) -> Column:
    """A short key at or after ``key``: cut after the first byte below 255, raised by one; a key of nothing but 255 stays."""
    key = _column(key)
    low = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.hex(F.substring(key, i, F.lit(1))) != "FF")
    i = (F.array_position(low, True) - 1).cast("int")
    return F.when((F.length(key) > 0) & (i >= 0), _cut_and_raise(key, i)).otherwise(key)


def _versioned(data: Column, own: Column, short: Column) -> Column:
    """``short`` with the version that sorts before all others, if it is shorter and larger than ``own``; else ``data``."""
    return F.when((F.length(short) < F.length(own)) & (own < short), F.concat(short, fixed64(pack_version(F.lit(MAX_SEQ), F.lit(PUT))))).otherwise(data)


def internal_separator(start: Column | str, limit: Column | str) -> Column:
    """:func:`shortest_separator` of internal keys."""
    start = _column(start)
    a, b = parse_internal_key(start)["user_key"], parse_internal_key(limit)["user_key"]
    return _versioned(start, a, shortest_separator(a, b))


def internal_successor(data: Column | str) -> Column:
    """:func:`short_successor` of an internal key."""
    data = _column(data)
    own = parse_internal_key(data)["user_key"]
    return _versioned(data, own, short_successor(own))
