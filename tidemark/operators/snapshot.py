"""Reading at a snapshot: the newest version of a key at or below a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import pack_version
from ..schema import ABSENT, DELETED, FOUND, PUT


#: Flips the sign bit, so that version words, which fill 64 bits, compare as if unsigned.
_SIGN = -(1 << 63)


def _version() -> Column:
    """``seq`` and ``op`` in one number that orders as they do, for sequence numbers of 56 bits."""
    return pack_version("seq", "op").bitwiseXOR(_SIGN)


def newest_of(log: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``seq``, ``op`` and ``value`` of each key's newest version.

    Two aggregates, of a number and of the value it picks: with values of fixed width the buffers are too, and no side of the shuffle sorts.
    """
    picked = log.groupBy(*keys).agg(F.max(_version()).alias("v"), F.max_by("value", _version()).alias("value"))
    word = F.col("v").bitwiseXOR(_SIGN)
    return picked.select(*keys, F.call_function("shiftrightunsigned", word, F.lit(8)).alias("seq"), word.bitwiseAND(255).cast("int").alias("op"), "value")


def status_of(op: Column) -> Column:
    return F.when(op.isNull(), ABSENT).when(op == PUT, FOUND).otherwise(DELETED)


def as_of(log: DataFrame, snapshot: int | Column | None) -> DataFrame:
    """Versions visible at ``snapshot`` (inclusive); None for all."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def latest(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """``(k, seq, op, value, status)``: each key's newest version, tombstones included.

    A partial aggregate on each side of one shuffle by key: a hot key costs a task one row.
    """
    return newest_of(as_of(log, snapshot), "k").withColumn("status", status_of(F.col("op")))


def snapshot_scan(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """``(k, seq, value)`` of the keys alive at ``snapshot``."""
    return latest(log, snapshot).where(F.col("op") == PUT).select("k", "seq", "value")


def tombstones(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``(k, seq)`` of the keys whose newest version is a delete."""
    return latest(log, snapshot).where(F.col("op") != PUT).select("k", "seq")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """One row for one key: ``(k, status, seq, value)``; both filters reach the scan."""
    seen = newest_of(as_of(log.where(F.col("k") == F.lit(key)), snapshot))
    kind = log.schema["k"].dataType
    return seen.select(F.lit(key).cast(kind).alias("k"), status_of(F.col("op")).alias("status"), "seq", "value")


def multi_get(log: DataFrame, lookups: DataFrame) -> DataFrame:
    """Each of ``lookups (lookup_id, k, snapshot_seq)`` answered: ``(lookup_id, k, snapshot_seq, status, seq, value)``.

    An as-of join by one shuffle and one sort: lookups and versions are laid in one order by key and sequence number, and the last
    version before a lookup is carried to it. So many lookups of one key cost no product with its versions. ``lookup_id`` is
    unique; the value of a lookup with a null key or snapshot is ABSENT.
    """
    value = log.schema["value"].dataType
    rows = lookups.select("k", F.col("snapshot_seq").alias("at"), F.lit(1).alias("turn"), "lookup_id", F.lit(None).cast("struct<seq:bigint,op:int>").alias("version"), F.lit(None).cast(value).alias("value"))
    versions = log.select("k", F.col("seq").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast(lookups.schema["lookup_id"].dataType).alias("lookup_id"), F.struct("seq", "op").alias("version"), "value")
    order = Window.partitionBy("k").orderBy("at", "turn", F.col("version.op")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(F.col("turn") == 0, F.struct("version.seq", "version.op", "value")), ignorenulls=True).over(order)
    both = versions.unionByName(rows).withColumn("v", F.when(F.col("k").isNotNull() & F.col("at").isNotNull(), carried)).where("turn = 1")
    return both.select("lookup_id", "k", F.col("at").alias("snapshot_seq"), status_of(F.col("v.op")).alias("status"), "v.seq", "v.value")


def history(log: DataFrame, key=None, snapshot: int | None = None) -> DataFrame:
    """Versions of one key, or of every key, newest first: ``version_no`` 1 is the newest."""
    rows = as_of(log, snapshot)
    if key is not None:
        rows = rows.where(F.col("k") == F.lit(key))
    order = Window.partitionBy("k").orderBy(F.desc("seq"), F.desc("op"))
    return rows.withColumn("version_no", F.row_number().over(order).cast("long"))


def compact(log: DataFrame, snapshots: list[int], *, keep_tombstones: bool = False) -> DataFrame:
    """The versions that some reader at one of ``snapshots``, or later than all, can still see; others are dropped.

    A version is seen from its own number up to the next newer one of its key. Tombstones that hide nothing older that is kept
    go too, unless ``keep_tombstones``. An addition of this engine.
    """
    order = Window.partitionBy("k").orderBy(F.desc("seq"), F.desc("op"))
    newer = F.lag("seq").over(order)
    seen = F.col("newer").isNull()
    for s in snapshots:
        seen = seen | ((F.col("seq") <= s) & (F.col("newer") > s))
    kept = log.withColumn("newer", newer).where(seen).drop("newer")
    if keep_tombstones:
        return kept
    return kept.withColumn("older", F.lead("seq").over(order)).where((F.col("op") == PUT) | F.col("older").isNotNull()).drop("older")
