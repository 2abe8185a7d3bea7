"""The 32-bit key hash and CRC-32C, as column expressions and for NumPy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .codec import byte_at

# The hash's factor, the seed for Bloom filters, CRC-32C's reflected polynomial, the mask's offset.
HASH_FACTOR = 0xC6A4A793
BLOOM_SEED = 0xBC9F1D34
CRC_POLYNOMIAL = 0x82F63B78
CRC_MASK = 0xA282EAD8
_32 = 0xFFFFFFFF


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(data: Column | str, seed: int = BLOOM_SEED) -> Column:
    """Hash of a binary column, as a BIGINT in 0..2**32-1; null of null.

    In Arrow batches, keys of one length together: products modulo 2**32 have no JVM expression that doesn't go byte by byte.
    """

    @F.pandas_udf("bigint")
    def hashed(keys: pd.Series) -> pd.Series:
        given = keys.notna().to_numpy()
        out = pd.array(np.zeros(len(keys), np.int64), dtype="Int64")
        out[given] = hash32_many([bytes(k) for k in keys[given]], seed).astype(np.int64)
        out[~given] = pd.NA
        return pd.Series(out)

    if session := SparkSession.getActiveSession():
        ship_package(session)
    return hashed(_column(data).cast("binary"))


def hash32_many(keys: list[bytes], seed: int = BLOOM_SEED) -> np.ndarray:
    """Hashes of many keys; keys of one length are worked on together."""
    out = np.zeros(len(keys), np.uint32)
    sizes = np.array([len(k) for k in keys])
    factor = np.uint32(HASH_FACTOR)
    for n in np.unique(sizes):
        where = np.flatnonzero(sizes == n)
        data = np.frombuffer(b"".join(keys[i] for i in where), np.uint8).reshape(len(where), n)
        h = np.full(len(where), (seed ^ (int(n) * HASH_FACTOR)) & _32, np.uint32)
        for i in range(0, n - n % 4, 4):
            h = (h + data[:, i : i + 4].copy().view("<u4")[:, 0]) * factor
            h ^= h >> np.uint32(16)
        if n % 4:
            rest = np.zeros((len(where), 4), np.uint8)
            rest[:, : n % 4] = data[:, n - n % 4 :]
            h = (h + rest.view("<u4")[:, 0]) * factor
            h ^= h >> np.uint32(24)
        out[where] = h
    return out


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """CRC-32C of each single byte."""
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(CRC_POLYNOMIAL), table >> np.uint64(1))
    return table


def crc32c(data: Column | str, start: int = 0) -> Column:
    """CRC-32C of a binary column continuing from ``start``, as a BIGINT."""
    data = _column(data).cast("binary")
    table = F.array(*(F.lit(int(x)) for x in crc_table()))
    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1)).otherwise(F.array().cast("array<int>"))

    def step(crc: Column, i: Column) -> Column:
        at = crc.bitwiseXOR(byte_at(data, i)).bitwiseAND(255)
        return F.get(table, at.cast("int")).bitwiseXOR(F.shiftright(crc, 8))

    return F.aggregate(places, F.lit(start ^ _32).cast("long"), step, lambda c: c.bitwiseXOR(_32))


def crc_mask(crc: Column | str) -> Column:
    """A checksum as it is stored: turned right by 15 bits, and a constant added."""
    crc = _column(crc)
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(_32)
    return (turned + F.lit(CRC_MASK)).bitwiseAND(_32)


def crc_unmask(stored: Column | str) -> Column:
    turned = (_column(stored) - F.lit(CRC_MASK) + F.lit(1 << 32)).bitwiseAND(_32)
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(_32)


@lru_cache(maxsize=1)
def _slices() -> list[list[int]]:
    """Tables for eight bytes at a time: entry ``k`` is a byte followed by ``k`` zero bytes."""
    first = crc_table()
    tables = [first]
    for _ in range(7):
        last = tables[-1]
        tables.append(first[(last & np.uint64(255)).astype(int)] ^ (last >> np.uint64(8)))
    return [t.tolist() for t in tables]


_LANE = 64


@lru_cache(maxsize=32)
def _shifts(level: int) -> np.ndarray:
    """What ``_LANE << level`` zero bytes after them make of checksums, by each of their four bytes: tables ``(4, 256)``."""
    if level:
        below = _shifts(level - 1)
        return np.stack([_shifted(row, below) for row in below])
    state = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    table = crc_table().astype(np.uint32)
    for _ in range(_LANE):
        state = table[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _shifted(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]


def _lanes(data: bytes, crc: int) -> int:
    """The running checksum after whole lanes of ``data``: all lanes side by side, then joined two by two."""
    lanes = np.frombuffer(data, np.uint8).reshape(-1, _LANE).copy()
    lanes[0, :4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
    table = crc_table().astype(np.uint32)
    state = np.zeros(len(lanes), np.uint32)
    for column in np.ascontiguousarray(lanes.T):
        state = table[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    level = 0
    while len(state) > 1:
        if len(state) % 2:
            state = np.concatenate([np.zeros(1, np.uint32), state])  # zeros in front change nothing
        state = _shifted(state[::2], _shifts(level)) ^ state[1::2]
        level += 1
    return int(state[0])


def crc32c_bytes(data: bytes, start: int = 0) -> int:
    """CRC-32C of a byte string: long ones in lanes, the rest eight bytes a step."""
    crc = start ^ _32
    if len(data) >= 16 * _LANE:
        whole = len(data) - len(data) % _LANE
        crc, data = _lanes(data[:whole], crc), data[whole:]
    t0, t1, t2, t3, t4, t5, t6, t7 = _slices()
    whole = len(data) - len(data) % 8
    for a, b in np.frombuffer(data[:whole], "<u4").reshape(-1, 2).tolist():
        a ^= crc
        crc = t7[a & 255] ^ t6[a >> 8 & 255] ^ t5[a >> 16 & 255] ^ t4[a >> 24] ^ t3[b & 255] ^ t2[b >> 8 & 255] ^ t1[b >> 16 & 255] ^ t0[b >> 24]
    for x in data[whole:]:
        crc = t0[(crc ^ x) & 255] ^ (crc >> 8)
    return crc ^ _32


def crc_mask_value(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + CRC_MASK) & _32


def crc_unmask_value(stored: int) -> int:
    turned = (stored - CRC_MASK) & _32
    return ((turned >> 17) | (turned << 15)) & _32
