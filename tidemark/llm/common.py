"""Helpers shared by the operators: shared storage, Arrow mapping, hashing of words and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    The files stay, as later results may read them, until :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list | pa.Array]], schema: str, *, rows: int = 512
) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows; it returns the output columns, by name, of ``schema``.

    Slices bound a Python worker's memory whatever the size of Spark's own batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([_column(got[f.name], f.type) for f in out], schema=out)

    return map_batches(df, run, schema)


def give_back() -> None:
    """Return what this process has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers.

    A worker waits for its next task beside the executor's JVM, also while stages run that need no Python: what a task has freed is
    given back at its end, else it stays part of the executor's memory.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and no other letters, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written() -> int:
    """How many tables this process has materialized and not discarded."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that this process has materialized, from number ``since`` on and but for the last ``keep``; results not yet written that read them are lost.

    Returns how many went.
    """
    gone = _written[since : len(_written) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(name)
    return len(gone)


#: A join side of at most so many rows of a few numbers is broadcast (some 20 MB); a larger one is shuffled.
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if counting shows that it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a bounded graph: hooks the larger root of each edge to the smaller and shortens paths, until no edge joins two roots."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
    nodes, place = np.unique(ends, return_inverse=True)
    u, v = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[at : at + 100_000]), "component": pa.array(nodes[root[at : at + 100_000]])})


#: Graphs of at most so many edges (32 MB) are settled within one task; larger ones by rounds over all tasks.
EDGES_IN_ONE_TASK = 2_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", *, one_task: int = EDGES_IN_ONE_TASK, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows ``(node, component)``, component the smallest node reachable.

    Up to ``one_task`` distinct edges, counted first, one task of an executor does it. Beyond, rounds of large-star and small-star
    steps shorten paths geometrically; each is written to the shared folder, until one leaves the edges as they were.
    Nothing is collected.
    """
    now = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct(), "edges"
    )
    if now.limit(one_task + 1).count() <= one_task:
        return materialize(map_batches(now.coalesce(1), _components, "node bigint, component bigint"), "components")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        now = materialize(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
