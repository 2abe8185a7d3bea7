"""Writing: puts and deletes are rows appended to a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import varint_length
from ..schema import DELETE, PUT


def from_table(df: DataFrame, key: str | Column, seq: str | Column, value: str | Column, op: Column | None = None) -> DataFrame:
    """A change log from any table: ``op`` defaults to a put for each row."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(key).alias("k"), as_column(seq).cast("long").alias("seq"), (F.lit(PUT) if op is None else op).cast("int").alias("op"), as_column(value).alias("value"))


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append versions ``rows (k, seq, value)``."""
    return log.unionByName(rows.select("k", "seq", F.lit(PUT).alias("op"), "value"))


def delete(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append tombstones for ``rows (k, seq)``."""
    value = F.lit(None).cast(log.schema["value"].dataType)
    return log.unionByName(rows.select("k", "seq", F.lit(DELETE).alias("op"), value.alias("value")))


def write_sorted(log: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store a log in key ranges, each sorted as readers want it: by key, newest version first. Range filters then skip row groups."""
    order = [F.col("k").asc(), F.col("seq").desc(), F.col("op").desc()]
    ranged = log.repartitionByRange(partitions, "k") if partitions else log.repartitionByRange("k")
    ranged.sortWithinPartitions(*order).write.mode("append").parquet(path)


def entry_size(key_bytes: Column, value_bytes: Column) -> Column:
    """Bytes of a version in packed form: both lengths as varints, the key with its 8-byte version word, the value."""
    inner = key_bytes + F.lit(8)
    return varint_length(inner) + inner + varint_length(value_bytes) + value_bytes
