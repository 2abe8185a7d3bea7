"""Approximate membership: Bloom filters with exact bits, one for each stretch of data, and lookups pruned by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import byte_at, decode_fixed32
from ..functions.hashing import hash32_many
from ..functions.text import let
from ..session import ship_package

#: One filter for each so many bytes of data.
SPAN_BITS = 11
SPAN = 1 << SPAN_BITS
_LEAST_BITS, _MOST_PROBES, _TRAILER = 64, 30, 5


def probes_for(bits_per_key: int) -> int:
    """Close to the best number of probes, ln 2 times the bits, within 1 to 30."""
    return min(max(int(bits_per_key * 0.69), 1), _MOST_PROBES)


def bloom_bytes(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    """A filter of ``keys``: its bits, then the number of probes."""
    return _bloom_of_hashes(hash32_many(keys), bits_per_key)


def _bloom_of_hashes(hashes: np.ndarray, bits_per_key: int) -> bytes:
    k = probes_for(bits_per_key)
    size = (max(len(hashes) * bits_per_key, _LEAST_BITS) + 7) // 8
    bits = np.zeros(size * 8, np.uint8)
    for places in _places(hashes, k, size * 8):
        bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([k])


def _places(hashes: np.ndarray, k: int, bits: int) -> Iterator[np.ndarray]:
    """The bit of each hash at each of ``k`` probes, a probe at a time."""
    step = (hashes >> np.uint32(17)) | (hashes << np.uint32(15))
    for j in range(k):
        yield (hashes + step * np.uint32(j)) % np.uint32(bits)


def bloom_filter(bits_per_key: int = 10) -> Callable[[Column | str], Column]:
    """An aggregate function: the filter of a group's binary keys. Groups are stretches of data and so bounded."""

    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> bytes:
        return bloom_bytes([bytes(k) for k in keys if k is not None], bits_per_key)

    return build


def bloom_matches(keys: list[bytes], data: bytes) -> np.ndarray:
    """Which of ``keys`` a filter may hold."""
    k = data[-1] if len(data) > 1 else 0
    if len(data) < 2 or not 1 <= k <= _MOST_PROBES:
        return np.full(len(keys), len(data) > 1)
    packed = np.frombuffer(data[:-1], np.uint8)
    out = np.ones(len(keys), bool)
    for places in _places(hash32_many(keys), k, len(packed) * 8):
        out &= (packed[places >> np.uint32(3)] >> (places & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out


def bloom_may_match(key: Column | str, filter_: Column | str) -> Column:
    """False only if the key was not added. A filter under two bytes holds nothing; one of over 30 probes is of an unknown kind and holds all; so does none."""

    @F.pandas_udf("boolean")
    def match(keys: pd.Series, filters: pd.Series) -> pd.Series:
        rows: dict[bytes | None, list[int]] = {}
        for i, f in enumerate(filters):
            rows.setdefault(None if f is None else bytes(f), []).append(i)
        out, held = np.ones(len(keys), bool), [b"" if k is None else bytes(k) for k in keys]
        for f, at in rows.items():
            if f is not None:
                out[at] = bloom_matches([held[i] for i in at], f)
        return pd.Series(out)

    if session := SparkSession.getActiveSession():
        ship_package(session)
    return match(key, filter_)


def bloom_filters(rows: DataFrame, group_col: str, key_col: str, bits_per_key: int = 10) -> DataFrame:
    """``(group_col, filter)``: the filter of each group of binary keys. Groups come sorted and are built many to a batch; of a group's keys their hashes are held, four bytes each."""
    kind = dict(rows.dtypes)[group_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], batch.schema.field(0).type), pa.array([f for _, f in done], pa.binary())], names=[group_col, "filter"])

        held: list[np.ndarray] = []
        done: list[tuple] = []
        now = batch = None
        begun = False
        for batch in batches:
            keys = batch.column(1).to_pylist()
            hashes = hash32_many([b"" if k is None else bytes(k) for k in keys])
            given = np.array([k is not None for k in keys], bool)
            for group, first, stop in _runs(batch.column(0).to_pylist()):
                if begun and group != now:
                    done.append((now, _bloom_of_hashes(np.concatenate(held), bits_per_key)))
                    held = []
                now, begun = group, True
                held.append(hashes[first:stop][given[first:stop]])
            if done:
                yield out()
                done = []
        if begun:
            done = [(now, _bloom_of_hashes(np.concatenate(held), bits_per_key))]
            yield out()

    ship_package(rows.sparkSession)
    return rows.select(group_col, key_col).repartition(group_col).sortWithinPartitions(group_col).mapInArrow(run, f"`{group_col}` {kind}, filter binary")


def _runs(groups: list) -> Iterator[tuple]:
    """``(group, first, stop)`` of each stretch of equal neighbours."""
    first = 0
    for stop in range(1, len(groups) + 1):
        if stop == len(groups) or groups[stop] != groups[first]:
            yield groups[first], first, stop
            first = stop


def probe_filters(probes: DataFrame, filters: DataFrame, group_col: str, key_col: str = "key") -> DataFrame:
    """``(group_col, key_col, may_match)``: each probe asked of its group's filter, ``filters (group_col, filter)``; a group without one may hold anything.

    A filter comes once, before its group's probes, and not with each of them, so filters may be as large as a row.
    """
    kinds = dict(probes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = data = None
        begun = False
        for batch in batches:
            groups, keys, asked = batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            may = np.ones(len(keys), bool)
            for group, first, stop in _runs(groups.to_pylist()):
                if not begun or group != now:
                    now, data, begun = group, None, True
                for i in range(first, stop):
                    if asked[i]:
                        break
                    data, first = batch.column(2)[i].as_py(), i + 1
                if data is not None and first < stop:
                    may[first:stop] = bloom_matches([b"" if k is None else bytes(k) for k in keys[first:stop]], data)
            yield pa.RecordBatch.from_arrays([groups, batch.column(1), pa.array(may)], names=[group_col, key_col, "may_match"]).filter(pa.array(asked))

    ship_package(probes.sparkSession)
    first = filters.select(group_col, F.lit(None).cast(kinds[key_col]).alias(key_col), "filter", F.lit(False).alias("asked"))
    rows = first.unionByName(probes.select(group_col, key_col, F.lit(None).cast("binary").alias("filter"), F.lit(True).alias("asked")))
    sorted_rows = rows.repartition(group_col).sortWithinPartitions(group_col, "asked")
    return sorted_rows.mapInArrow(run, f"`{group_col}` {kinds[group_col]}, `{key_col}` {kinds[key_col]}, may_match boolean")


def block_filters(df: DataFrame, *, offset_col: str = "block_offset", key_col: str = "key", build: Callable[[Column | str], Column] | None = None) -> DataFrame:
    """``(filter_index, filter)``: a filter for each 2 KiB of data up to the last that has keys, empty where there is none.

    ``build`` is any aggregate from keys to bytes; by default a Bloom filter of ten bits a key.
    """
    rows = df.select(F.floor(F.col(offset_col) / SPAN).cast("long").alias("filter_index"), F.col(key_col).alias("key"))
    built = rows.groupBy("filter_index").agg(build("key").alias("filter")) if build else bloom_filters(rows, "filter_index", "key")
    last = rows.agg(F.max("filter_index").alias("last")).where("last is not null")
    every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("filter_index"))
    return every.join(built, "filter_index", "left").select("filter_index", F.coalesce("filter", F.lit(b"")).alias("filter"))


def serialize_filters(filters: DataFrame) -> DataFrame:
    """One row, ``block``: the filters, their offsets, the offsets' place, the logarithm of the span. For one table's filters, which fit a row."""

    @F.pandas_udf("binary")
    def whole(lists: pd.Series) -> pd.Series:
        def block(parts: list[bytes]) -> bytes:
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)  # each filter's offset, then the offsets' place
            return b"".join((*parts, ends.astype("<u4").tobytes(), bytes([SPAN_BITS])))

        return lists.map(lambda parts: block([bytes(p) for p in parts]))

    ship_package(filters.sparkSession)
    ordered = filters.agg(F.array_sort(F.collect_list(F.struct("filter_index", "filter"))).alias("f"))
    return ordered.select(whole(F.transform("f", lambda x: x["filter"])).alias("block"))


def parse_filters(block: Column | str) -> Column:
    """``struct(span_bits, end, filters array<struct(start, limit, filter)>)`` of a serialized block: its own span, the place of the offsets, the filters.

    A filter whose bounds are not in order or lie beyond the offsets' place is null. Null as a whole for a block that is too short or
    whose offsets would lie outside it.
    """
    # held as it is: a row's bytes are copied each time that a column is looked at
    return let(F.col(block) if isinstance(block, str) else block, _parsed)


def _parsed(block: Column) -> Column:
    n = F.length(block)

    def parsed(end: Column) -> Column:
        count = F.floor((n - _TRAILER - end) / 4).cast("int")
        offset = lambda i: decode_fixed32(F.substring(block, (end + i * 4 + 1).cast("int"), F.lit(4)))

        def cell(start: Column, limit: Column) -> Column:
            inside = (start <= limit) & (limit <= end)
            return F.struct(start.alias("start"), limit.alias("limit"), F.when(inside, F.substring(block, (start + 1).cast("int"), (limit - start).cast("int"))).alias("filter"))

        cells = F.transform(F.sequence(F.lit(0), count - 1), lambda i: let(offset(i), lambda start: let(offset(i + 1), lambda limit: cell(start, limit))))
        none = F.array().cast("array<struct<start:bigint,limit:bigint,filter:binary>>")
        whole = F.struct(byte_at(block, n - 1).cast("int").alias("span_bits"), end.alias("end"), F.when(count > 0, cells).otherwise(none).alias("filters"))
        return F.when(end <= n - _TRAILER, whole)

    return F.when(n >= _TRAILER, let(decode_fixed32(F.substring(block, n - 4, F.lit(4))), parsed))


def block_may_match(block_offset: Column | str, key: Column | str, parsed: Column, match: Callable[[Column, Column], Column] = bloom_may_match) -> Column:
    """Whether the data at ``block_offset`` may hold ``key``, by a block as parsed, with its own span.

    An empty filter holds nothing. Past the filters, with damaged bounds or in a block that doesn't parse, anything may be held.
    """
    block_offset = F.col(block_offset) if isinstance(block_offset, str) else block_offset
    key = F.col(key) if isinstance(key, str) else key
    bits = parsed["span_bits"]
    place = F.when(bits < 63, F.call_function("shiftright", block_offset.cast("long"), bits)).otherwise(0)
    cell = F.when(place < F.size(parsed["filters"]), F.get(parsed["filters"], place.cast("int")))
    return (
        F.when(parsed.isNull() | cell.isNull(), True).when(cell["start"] == cell["limit"], False).when(cell["filter"].isNull(), True)
        .otherwise(match(key, cell["filter"]))
    )


def filter_rows(blocks: DataFrame, block_col: str = "block") -> DataFrame:
    """``(filter_index, start, limit, filter)``, a row for each filter of serialized blocks: what :func:`pruned_lookup` joins."""
    return blocks.select(F.posexplode(parse_filters(block_col)["filters"]).alias("at", "f")).select(F.col("at").cast("long").alias("filter_index"), "f.start", "f.limit", "f.filter")


def pruned_lookup(data: DataFrame, filters: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes (block_offset, key)`` that ``data (block_offset, key)`` holds, checked exactly where a filter lets them through."""
    at = F.floor(F.col("block_offset") / SPAN).cast("long")
    asked = probes.withColumn("filter_index", at).join(filters, "filter_index", "left")
    may = F.when(F.col("filter").isNull(), True).when(F.length("filter") == 0, False).otherwise(bloom_may_match("key", "filter"))
    kept = asked.where(may).select("block_offset", "key")
    return kept.join(data.select("block_offset", "key").distinct(), ["block_offset", "key"], "left_semi")
