"""Cursors as relations: ordered scans, seeks and neighbours over ``k``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .order import BYTEWISE, Order

def version_order(order: Order = BYTEWISE) -> list[Column]:
    """Keys ascending, then newest version first. Never by the packed version word, which is signed here."""
    return [order("k").asc(), F.desc("seq"), F.desc("op")]


def scan(log: DataFrame, order: Order = BYTEWISE) -> DataFrame:
    """All versions in order."""
    return log.orderBy(*version_order(order))


def reverse_scan(df: DataFrame, limit: int | None = None, order: Order = BYTEWISE) -> DataFrame:
    out = df.orderBy(order("k").desc())
    return out if limit is None else out.limit(limit)


def range_scan(df: DataFrame, low=None, high=None, order: Order = BYTEWISE) -> DataFrame:
    """Rows with ``low <= k < high``; an open end for None. In the natural order the comparison reaches the scan, so sorted files are skipped."""
    ends = [order("k") >= order(F.lit(low))] * (low is not None) + [order("k") < order(F.lit(high))] * (high is not None)
    return df.where(reduce(lambda a, b: a & b, ends)) if ends else df


def prefix_scan(df: DataFrame, prefix) -> DataFrame:
    """Rows whose key, text or binary, starts with ``prefix``."""
    return df.where(F.startswith("k", F.lit(prefix)))


def seek(df: DataFrame, target, order: Order = BYTEWISE) -> DataFrame:
    """The first row at or after ``target``, or none."""
    return df.where(order("k") >= order(F.lit(target))).orderBy(order("k")).limit(1)


def first(df: DataFrame, order: Order = BYTEWISE) -> DataFrame:
    return df.orderBy(order("k")).limit(1)


def last(df: DataFrame, order: Order = BYTEWISE) -> DataFrame:
    return df.orderBy(order("k").desc()).limit(1)


def contains(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys (k)`` with ``present`` (boolean)."""
    have = df.select("k").distinct().withColumn("present", F.lit(True))
    return keys.join(have, "k", "left").select(*keys.columns, F.coalesce("present", F.lit(False)).alias("present"))


#: Key ranges are cut at a sample of so many keys a range, the first by a hash.
KEYS_A_RANGE = 40


def _plain(key):
    """A collected key as a value that sets hold."""
    return tuple(map(_plain, key)) if isinstance(key, tuple) else bytes(key) if isinstance(key, bytearray) else key


def _literal(key, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*(_literal(k, f.dataType).alias(f.name) for k, f in zip(key, kind.fields)))
    return F.lit(key).cast(kind)


def _ranged(df: DataFrame, partitions: int | None, order: Order) -> DataFrame:
    """Rows with ``place``, their key's sort key, and ``part``, the number of its range, the same in any evaluation.

    There are as many ranges as the session has shuffle partitions, about equal, cut at sampled keys; a key's is found by halving.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("place", order("k"))
    sample = placed.select("place").where("place is not null").orderBy(F.xxhash64("place"), "place").limit(KEYS_A_RANGE * n)
    kind = placed.schema["place"].dataType
    bounds = list(map(_plain, sample.agg(F.array_sort(F.collect_set("place"))).first()[0]))
    cuts = sorted({bounds[len(bounds) * i // n] for i in range(1, n)}) if bounds else []
    array = F.array(*(_literal(c, kind) for c in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    below = lambda at, step: (at + step <= len(cuts)) & (F.get(array, at + step - 1) <= F.col("place"))
    part = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(0)) if cuts else F.lit(0)
    return placed.withColumn("part", F.when(F.col("place").isNull(), 0).otherwise(part))


def seek_many(df: DataFrame, targets: DataFrame, partitions: int | None = None, order: Order = BYTEWISE) -> DataFrame:
    """For each of ``targets (target_id, target)`` the first key at or after it: ``(target_id, target, found)``.

    Distinct keys and distinct targets go into common key ranges. From a range's end to its start the last key met is carried over the
    targets, in time linear in the rows; what a range cannot answer is the first key of a later range. A target asked for many
    times costs one row until its answer is joined to those who asked. A null target finds nothing.
    """
    kind = df.schema["k"].dataType
    keys = df.select("k", F.lit(1).alias("turn")).where("k is not null").distinct()
    named = targets.select("target_id", F.col("target").cast(kind).alias("target"))
    asked = named.select(F.col("target").alias("k"), F.lit(0).alias("turn")).where("k is not null").distinct()
    both = _ranged(keys.unionByName(asked), partitions, order)
    back = Window.partitionBy("part").orderBy(F.desc("place"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("found", F.last(F.when(F.col("turn") == 1, F.col("k")), ignorenulls=True).over(back)).where("turn = 0").select("k", "part", "found")
    firsts = both.groupBy("part").agg(F.min(F.when(F.col("turn") == 1, F.struct("place", "k"))).alias("low"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    beyond = firsts.select("part", F.last(F.col("low.k"), ignorenulls=True).over(later).alias("later"))
    answers = own.join(F.broadcast(beyond), "part").select(F.col("k").alias("answered"), F.coalesce("found", "later").alias("found"))
    return named.join(answers, F.col("target") == F.col("answered"), "left").select("target_id", "target", "found")


def neighbours(df: DataFrame, partitions: int | None = None, order: Order = BYTEWISE) -> DataFrame:
    """Each row with ``previous`` and ``following`` keys; keys are unique.

    Within key ranges these are window functions; at a range's ends they come from the ranges beside it, whose first and last keys are
    a row a range. No single task sees all keys.
    """
    ranged = _ranged(df, partitions, order)
    within = Window.partitionBy("part").orderBy("place")
    own = ranged.withColumn("previous", F.lag("k").over(within)).withColumn("following", F.lead("k").over(within))
    ends = ranged.groupBy("part").agg(F.min(F.struct("place", "k"))["k"].alias("low"), F.max(F.struct("place", "k"))["k"].alias("high"))
    beside = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(beside).alias("before"), F.lead("low").over(beside).alias("after"))
    both = own.join(F.broadcast(ends), "part", "left")
    return both.select(*df.columns, F.coalesce("previous", "before").alias("previous"), F.coalesce("following", "after").alias("following"))


@contextmanager
def cleaned_up(df: DataFrame, *callbacks: Callable[[], object]) -> Iterator[DataFrame]:
    """``df`` for the length of a ``with`` block, at whose end, by an error or not, it leaves the cache and ``callbacks`` run in order.

    All callbacks run; the first error among them is raised then.
    """
    errors: list[Exception] = []
    try:
        yield df
    finally:
        for run in (df.unpersist, *callbacks):
            try:
                run()
            except Exception as e:  # the others must run too
                errors.append(e)
    if errors:
        raise errors[0]


def empty_relation(spark: SparkSession, schema: StructType) -> DataFrame:
    """A cursor over nothing."""
    return spark.createDataFrame([], schema)


def failed_relation(spark: SparkSession, schema: StructType, message: str) -> DataFrame:
    """A cursor that carries an error: reading it raises."""
    one = spark.range(1).where(F.raise_error(F.lit(message)).isNull())
    return one.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
