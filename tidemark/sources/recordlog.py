"""The record log: a file of checksummed records in blocks of 32 KiB, written, read in parallel, and its damage accounted for.

A record is one or more fragments, each with a header: the masked CRC-32C of type and data (4 bytes), the data's length (2 bytes), the
type (1 byte). No fragment spans two blocks; a block's last bytes, too few for a header, are zeros.

Reading looks at each block by itself: what it holds are events, fragments or damage, in the order of their offsets. Records come of
the events by window functions over a file's offsets and sizes, and their bytes straight from the blocks. ``read_sequentially`` says the
same of one file in a plain loop.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.hashing import crc32c_bytes, crc_mask_value, crc_unmask_value
from ..functions.text import let
from ..schema import LOG_RECORD
from ..session import ship_package

# Fixed values of the format.
BLOCK, HEADER = 32 * 1024, 7
ZERO, FULL, FIRST, MIDDLE, LAST = range(5)
BAD, UNKNOWN = "bad", "unknown"

TOO_LONG, MISMATCH = "bad record length", "checksum mismatch"
NO_END, NO_START, BROKEN, STRANGE = "partial record without end({})", "missing start of fragmented record({})", "error in middle of record", "unknown record type {}"

_NAMES = {FULL: "full", FIRST: "first", MIDDLE: "middle", LAST: "last"}


# Writing


def frame(payloads: Iterable[bytes], written: int = 0, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes to append to a log of ``written`` bytes for each payload."""
    at = written % block
    for payload in payloads:
        out, done, begun = [], 0, False
        while True:
            if block - at < HEADER:
                out.append(b"\0" * (block - at))
                at = 0
            part = payload[done : done + block - at - HEADER]
            done += len(part)
            end = done == len(payload)
            kind = (LAST if end else MIDDLE) if begun else (FULL if end else FIRST)
            body = bytes([kind]) + part
            out.append(crc_mask_value(crc32c_bytes(body)).to_bytes(4, "little") + len(part).to_bytes(2, "little") + body)
            at += HEADER + len(part)
            begun = True
            if end:
                break
        yield b"".join(out)


#: A log file of about this size is closed and another begun.
LOG_BYTES = 64 << 20


def encode_log(df: DataFrame, payload_col: str = "payload", *, most: int = LOG_BYTES) -> DataFrame:
    """``(part, piece, content)``: each partition's payloads, in its order, as the bytes of logs of at most ``most`` bytes or one record. Null payloads are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def log() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "content": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for payload in batch.column(0).to_pylist():
                if payload is None:
                    continue
                (data,) = frame([bytes(payload)], size)
                if held and size + len(data) > most:
                    yield log()
                    piece, held, size = piece + 1, [], 0
                    (data,) = frame([bytes(payload)])
                held.append(data)
                size += len(data)
        if held or not piece:
            yield log()

    ship_package(df.sparkSession)
    return df.select(F.col(payload_col).cast("binary")).mapInArrow(run, "part int, piece int, content binary")


def extend_logs(logs: DataFrame, rows: DataFrame) -> DataFrame:
    """Logs ``(path, content)`` reopened: the payloads of ``rows (path, place, payload)``, by place, are added to the log of their path, or to a new one.

    One task writes a log, which is one row and fits it; :func:`extend_blocks` is for longer ones. Null payloads are left out.
    """

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        path = (old if old.num_rows else new).column("path")[0].as_py()
        content = b"".join(bytes(c) for c in old.column("content").to_pylist() if c is not None)
        payloads = [bytes(p) for p in new.sort_by("place").column("payload").to_pylist() if p is not None]
        return pa.table({"path": pa.array([path], pa.string()), "content": pa.array([content + b"".join(frame(payloads, len(content)))], pa.binary())})

    ship_package(rows.sparkSession)
    old, new = logs.select("path", "content").groupBy("path"), rows.select("path", "place", F.col("payload").cast("binary").alias("payload")).groupBy("path")
    return old.cogroup(new).applyInArrow(run, "path string, content binary")


#: A log's new bytes are written in stretches of about this many, each by one task.
STRETCH = 8 << 20


def record_end(at: int, size: int, block: int = BLOCK) -> tuple[int, int]:
    """Where a record of ``size`` bytes begins and ends in a log of ``at`` bytes."""
    left = block - at % block
    start = at + left if left < HEADER else at
    room = block - start % block - HEADER
    if size <= room:
        return start, start + HEADER + size
    more = -(-(size - room) // (block - HEADER))
    return start, start - start % block + more * block + HEADER + (size - room) - (more - 1) * (block - HEADER)


def extend_blocks(blocks: DataFrame | None, rows: DataFrame, *, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Logs as blocks ``(path, place, data)``, or none, reopened: as :func:`extend_logs`, for logs longer than a row or a task holds.

    Where a record begins hangs on all before it, so the sizes of a log's payloads, and no more of them, go through one task, which
    tells where each stretch of records begins. Stretches are then written side by side, and the blocks they share are put together.
    Rows of one place are in the order of their sizes and bytes, and in one stretch.
    """
    spark = rows.sparkSession
    ship_package(spark)
    (kind,) = (t for c, t in rows.dtypes if c == "place")
    rows = rows.select("path", "place", F.col("payload").cast("binary").alias("payload")).where("payload is not null")
    sizes = rows.select("path", F.lit(1).alias("new"), "place", F.length("payload").cast("long").alias("size"))
    if blocks is not None:
        ends = blocks.groupBy("path").agg(F.max(F.col("place") + F.length("data")).alias("size"))
        sizes = sizes.unionByName(ends.select("path", F.lit(0).alias("new"), F.lit(None).cast(kind).alias("place"), "size"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, place, at, due = False, None, None, 0, 0
        for batch in batches:
            found: list[tuple] = []
            for path, new, here, size in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or path != now:
                    begun, now, place, at, due = True, path, None, 0, -1
                if not new:
                    at = size
                    continue
                if due < 0 or (at >= due and here != place):
                    found.append((path, here, at))
                    due = at + stretch
                place, at = here, record_end(at, size, block)[1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), (batch.schema.field(0), batch.schema.field(2), pa.field("at", pa.int64())))], names=["path", "place", "at"])

    order = [F.col("path"), F.col("new"), F.col("place").asc_nulls_last(), F.col("size")]
    begins = sizes.select("path", "new", "place", "size").repartition("path").sortWithinPartitions(*order).mapInArrow(begin, f"path string, place {kind}, at bigint")
    # a row for each STRETCH bytes of new log
    cuts: dict[str | None, tuple[list, list[int]]] = {}
    for path, place, at in sorted((tuple(r) for r in begins.collect()), key=lambda r: r[2]):
        places, offsets = cuts.setdefault(path, ([], []))
        places.append(place)
        offsets.append(at)
    cuts_sent = spark.sparkContext.broadcast(cuts)

    def stretch_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from bisect import bisect_right

        cuts = cuts_sent.value
        for paths, places in batches:
            out = []
            for path, place in zip(paths.to_pylist(), places.to_pylist()):
                begins, offsets = cuts[path]
                known = len(begins) - (begins[-1] is None)  # rows without a place come last
                out.append(offsets[-1] if place is None else offsets[max(bisect_right(begins, place, 0, known) - 1, 0)])
            yield pa.array(out, pa.int64())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, at, first, held = False, None, 0, 0, []

        def cut(data: bytes, whole: bool) -> tuple[list[tuple], bytes, int]:
            """The blocks of ``data`` from ``first`` on, and what is left unless ``whole``."""
            out, done = [], 0
            while done < len(data):
                n = block - (first + done) % block
                if len(data) - done < n and not whole:
                    break
                out.append((now[0], (first + done) // block * block, first + done, data[done : done + n]))
                done += n
            return out, data[done:], first + min(done, len(data))

        for batch in batches:
            found: list[tuple] = []
            for path, begins, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or (path, begins) != now:
                    if begun:
                        found += cut(b"".join(held), True)[0]
                    begun, now, at, first, held = True, (path, begins), begins, begins, []
                (data,) = frame([payload], at, block)
                held.append(data)
                at += len(data)
                if at - first >= 1 << 20:
                    more, rest, first = cut(b"".join(held), False)
                    found, held = found + more, [rest]
            if found:
                yield fragments(found)
        if begun and (found := cut(b"".join(held), True)[0]):
            yield fragments(found)

    def fragments(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["path", "place", "at", "data"])

    begun_at = F.arrow_udf(stretch_of, "bigint")("path", "place")
    dealt = rows.withColumn("begins", begun_at).repartition("path", "begins")
    dealt = dealt.sortWithinPartitions("path", "begins", F.col("place").asc_nulls_last(), F.length("payload"), "payload")
    parts = dealt.select("path", "begins", "payload").mapInArrow(write, "path string, place bigint, at bigint, data binary")
    if blocks is not None:
        parts = parts.unionByName(blocks.select("path", "place", F.col("place").alias("at"), "data"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "data"))), F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return parts.groupBy("path", "place").agg(joined.alias("data"))


# Reading


def block_events(data: bytes, offset: int, *, short: bool, verify: bool = True, start: int = 0) -> Iterator[tuple[int, int, str, bytes, int, str | None]]:
    """Events of one block: ``(offset, end, kind, data, dropped bytes, reason)``; ``end`` is where reading stands after it.

    In a block that the file's end cuts short, a header or record that isn't whole ends the log in silence: its writer died.
    Fragments that begin before ``start`` count as bad, without a report.
    """
    at = 0
    while len(data) - at >= HEADER:
        size = int.from_bytes(data[at + 4 : at + 6], "little")
        kind = data[at + 6]
        rest, stop = len(data) - at, offset + len(data)
        if HEADER + size > rest:
            if not short:
                yield offset + at, stop, BAD, b"", rest, TOO_LONG
            return
        if kind == ZERO and size == 0:
            yield offset + at, stop, BAD, b"", 0, None
            return
        if verify and crc_unmask_value(int.from_bytes(data[at : at + 4], "little")) != crc32c_bytes(data[at + 6 : at + HEADER + size]):
            yield offset + at, stop, BAD, b"", rest, MISMATCH
            return
        begin, at = at, at + HEADER + size
        if offset + begin < start:
            yield offset + begin, offset + at, BAD, b"", 0, None
        elif kind in _NAMES:
            yield offset + begin, offset + at, _NAMES[kind], data[begin + HEADER : at], 0, None
        else:
            yield offset + begin, offset + at, UNKNOWN, data[begin + HEADER : at], 0, STRANGE.format(kind)


def first_block(start: int, block: int = BLOCK) -> int:
    """Offset of the first block to read for records from ``start`` on: no record begins in a block's last six bytes."""
    within = start % block
    return start - within + (block if within > block - 6 else 0)


Blocks = Iterable[tuple[int, bytes, bool]]


def walk(blocks: Blocks, *, verify: bool = True, start: int = 0) -> Iterator[tuple[str, int, bytes | str]]:
    """Of blocks ``(offset, data, short)`` in order: ``("record", offset, data)`` and ``("drop", bytes, reason)``, as they come."""
    held: list[bytes] | None = None
    held_at, resync = 0, start > 0

    def drop(n: int, reason: str, end: int) -> Iterator[tuple]:
        if end - n >= start:
            yield "drop", n, reason

    for offset, data, short in blocks:
        for at, end, kind, part, lost, reason in block_events(data, offset, short=short, verify=verify, start=start):
            if lost:
                yield from drop(lost, reason, end)
            if resync:
                resync = kind == "middle"
                if kind in ("middle", "last"):
                    continue
            size = sum(map(len, held or ()))
            if kind in ("full", "first"):
                if size:
                    yield from drop(size, NO_END.format(1 if kind == "full" else 2), end)
                held, held_at = (None, 0) if kind == "full" else ([part], at)
                if kind == "full":
                    yield "record", at, part
            elif kind in ("middle", "last"):
                if held is None:
                    yield from drop(len(part), NO_START.format(1 if kind == "middle" else 2), end)
                    continue
                held.append(part)
                if kind == "last":
                    yield "record", held_at, b"".join(held)
                    held = None
            else:
                if kind == UNKNOWN:
                    yield from drop(len(part) + size, reason, end)
                elif held is not None:
                    yield from drop(size, BROKEN, end)
                held = None


def read_sequentially(content: bytes, *, verify: bool = True, start: int = 0, block: int = BLOCK) -> tuple[list[tuple[int, bytes]], list[tuple[int, str]]]:
    """Records ``(offset, data)`` and drops ``(bytes, reason)`` of one log."""
    cuts = ((at, content[at : at + block], len(content) - at < block) for at in range(first_block(start, block), len(content), block))
    found = list(walk(cuts, verify=verify, start=start))
    return [(at, data) for what, at, data in found if what == "record"], [(n, reason) for what, n, reason in found if what == "drop"]


_EVENT = "path string, at bigint, end bigint, kind string, size bigint, lost bigint, reason string"


def log_blocks(files: DataFrame, *, start: int = 0, block: int = BLOCK) -> DataFrame:
    """``(path, place, data)``: the blocks of ``files (path, content)`` dealt out, so that one large file is parsed by many tasks."""
    size = F.length("content")
    places = F.sequence(F.lit(first_block(start, block)), size - 1, F.lit(block))
    # cut all at once: a row of content that goes beside each of its blocks would be copied as often
    cut = let(F.col("content"), lambda content: F.transform(places, lambda at: F.struct(at.cast("long").alias("place"), F.substring(content, at + 1, F.lit(block)).alias("data"))))
    blocks = files.where(size > first_block(start, block)).select("path", F.explode(cut).alias("b")).select("path", "b.place", "b.data")
    return blocks.repartition("path", "place")


def log_events(blocks: DataFrame, *, verify: bool = True, start: int = 0, block: int = BLOCK) -> DataFrame:
    """Events of blocks, with the sizes of their data. A block of fewer than ``block`` bytes is one that the file's end cuts short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(path, at, end, kind, len(part), lost, reason) for at, end, kind, part, lost, reason in block_events(data, place, short=len(data) < block, verify=verify, start=start)]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                names = ["path", "at", "end", "kind", "size", "lost", "reason"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    ship_package(blocks.sparkSession)
    return blocks.select("path", "place", "data").mapInArrow(run, _EVENT)


def _grouped(events: DataFrame, start: int) -> DataFrame:
    """Events with the group they belong to: each full, first, bad or unknown event opens one, in which middles and lasts follow."""
    order = Window.partitionBy("path").orderBy("at")
    opens = ~F.col("kind").isin("middle", "last")
    rows = events.withColumn("opens", opens).withColumn("group", F.sum(opens.cast("long")).over(order))
    if start > 0:  # what is left of a record that began before
        quiet = ~opens
        lasts = F.sum((F.col("kind") == "last").cast("long")).over(order)
        rows = rows.withColumn("lasts", lasts).where(~((F.col("group") == 0) & quiet & ((F.col("lasts") == 0) | ((F.col("lasts") == 1) & (F.col("kind") == "last")))))
    head = Window.partitionBy("path", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.first("kind").over(head))
    before = F.sum((F.col("kind") == "last").cast("long")).over(Window.partitionBy("path", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("closed", F.coalesce(before, F.lit(0)) > 0)


def parse(files: DataFrame, *, verify: bool = True, start: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Records ``(path, record_offset, payload)`` and drops ``(path, at, bytes, reason)`` of ``files (path, content)``.

    Across a file only offsets and sizes are looked at. The bytes of a record's fragments come from the blocks that hold them, and are
    gathered record by record; a record fits a row anyhow.
    """
    return parse_blocks(log_blocks(files, start=start, block=block), verify=verify, start=start, block=block)


def parse_blocks(blocks: DataFrame, *, verify: bool = True, start: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """As :func:`parse`, of logs as blocks ``(path, place, data)``, which may be longer than a row holds."""
    blocks = blocks.where(F.col("place") >= first_block(start, block)).select("path", "place", "data")
    rows = _grouped(log_events(blocks, verify=verify, start=start, block=block), start)
    member = (F.col("head") == "first") & ~F.col("closed")
    wanted = rows.where(member | (F.col("kind") == "full")).select("path", (F.col("at") - F.col("at") % block).alias("place"), "at", "kind", "size", "group")
    held = blocks.select("path", "place", F.col("data").alias("bytes"))
    data = F.substring("bytes", (F.col("at") - F.col("place")).cast("int") + HEADER + 1, F.col("size").cast("int"))
    parts = wanted.join(held, ["path", "place"]).withColumn("data", data).groupBy("path", "group").agg(
        F.min("at").alias("record_offset"), F.max(F.col("kind").isin("full", "last").cast("int")).alias("whole"), F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    records = parts.where("whole = 1").select("path", "record_offset", joined.alias("payload"))

    sizes = rows.groupBy("path", "group").agg(
        F.min("head").alias("head"), F.max((member & (F.col("kind") == "last")).cast("int")).alias("whole"), F.sum(F.when(member, F.col("size")).otherwise(0)).alias("size"),
        F.min(F.when(F.col("opens"), F.col("at"))).alias("at"), F.min(F.when(F.col("opens"), F.col("end"))).alias("end"), F.min(F.when(F.col("opens"), F.col("size"))).alias("own"),
        F.min(F.when(F.col("opens"), F.col("lost"))).alias("lost"), F.min(F.when(F.col("opens"), F.col("reason"))).alias("reason"),
    )
    order = Window.partitionBy("path").orderBy("group")
    open_before = (F.lag("head").over(order) == "first") & (F.lag("whole").over(order) == 0)
    sizes = sizes.withColumn("held", F.when(open_before, F.lag("size").over(order)))
    cut = (
        F.when((F.col("head") == "full") & (F.col("held") > 0), NO_END.format(1)).when((F.col("head") == "first") & (F.col("held") > 0), NO_END.format(2))
        .when((F.col("head") == BAD) & F.col("held").isNotNull(), BROKEN)
    )
    drops = (
        sizes.select("path", "at", "end", F.col("held").alias("bytes"), cut.alias("reason")).where("reason is not null")
        .unionByName(sizes.where((F.col("head") == BAD) & (F.col("lost") > 0)).select("path", "at", "end", F.col("lost").alias("bytes"), "reason"))
        .unionByName(sizes.where(F.col("head") == UNKNOWN).select("path", "at", "end", (F.col("own") + F.coalesce("held", F.lit(0))).alias("bytes"), "reason"))
        .unionByName(
            rows.where(~F.col("opens") & ~member).select("path", "at", "end", F.col("size").alias("bytes"), F.when(F.col("kind") == "middle", NO_START.format(1)).otherwise(NO_START.format(2)).alias("reason"))
        )
    )
    seen = drops.where(F.col("end") - F.col("bytes") >= start)
    return records, seen.select("path", "at", F.col("bytes").cast("long").alias("bytes"), "reason")


def read_log(spark: SparkSession, path: str, *, verify: bool = True, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records and drops of all log files at ``path``, which any file system of Spark's may hold."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse(files, verify=verify, start=start)


# As a data source


def _store(path: str):
    """The file system that holds ``path``, by its URI or else the local one, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class _File(InputPartition):
    """A file of the store of ``base``: the records that begin at ``start`` or later and end by ``end``, if there is one."""

    def __init__(self, base: str, path: str, start: int = 0, end: int | None = None):
        self.base, self.path, self.start, self.end = base, path, start, end


class _Written(WriterCommitMessage):
    def __init__(self, path: str, temporary: str):
        self.path, self.temporary = path, temporary


def _log_files(base: str) -> dict[str, int]:
    """The log files at ``base`` and their sizes."""
    from pyarrow import fs

    store, path = _store(base)
    info = store.get_file_info(path)
    found = store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _rows(part: _File, verify: bool) -> Iterator[tuple]:
    """Records of a file, which is read block by block."""
    with _store(part.base)[0].open_input_file(part.path) as file:
        end = file.size() if part.end is None else min(part.end, file.size())

        def blocks() -> Blocks:
            for at in range(first_block(part.start), end, BLOCK):
                file.seek(at)
                data = file.read(min(BLOCK, end - at))
                yield at, data, len(data) < BLOCK

        for what, offset, payload in walk(blocks(), verify=verify, start=part.start):
            if what == "record":
                yield part.path, offset, payload


def _verifies(options: dict) -> bool:
    return options.get("verifyChecksum", "true").lower() == "true"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.verify, self.start = options["path"], _verifies(options), int(options.get("startOffset", "0"))

    def partitions(self) -> list[_File]:
        return [_File(self.path, f, self.start) for f in _log_files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(partition, self.verify)


class _Tail(DataSourceStreamReader):
    """Follows a folder of logs: an offset is each file's size when last looked at, and a batch ends there. Files grow by whole records."""

    def __init__(self, options: dict):
        self.path, self.verify = options["path"], _verifies(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return _log_files(self.path)

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(self.path, f, start.get(f, 0), size) for f, size in sorted(end.items()) if size > start.get(f, 0)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(partition, self.verify)


class _Writer(DataSourceWriter):
    """Each task writes log files of its own, seen once the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> _Written:
        import uuid

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        temporary, final = f"{folder}/.{name}", f"{folder}/{name}.log"
        with store.open_output_stream(temporary) as file:
            for part in frame(bytes(row["payload"]) for row in rows):
                file.write(part)
        return _Written(final, temporary)

    def commit(self, messages: list[_Written]) -> None:
        store, _ = _store(self.path)
        if self.overwrite:
            for f in _log_files(self.path):
                store.delete_file(f)
        for m in messages:
            store.move(m.temporary, m.path)

    def abort(self, messages: list[_Written]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.temporary).is_file:
                store.delete_file(m.temporary)


def append_to_file(path: str, payloads: Iterable[bytes]) -> int:
    """Reopen one log file and add records at its end, in the block its size says; returns its new size."""
    store, name = _store(path)
    info = store.get_file_info(name)
    size = info.size or 0
    with store.open_append_stream(name) if info.is_file else store.open_output_stream(name) as file:
        for part in frame(payloads, size):
            file.write(part)
            size += len(part)
    return size


class RecordLogSource(DataSource):
    """``spark.read.format("recordlog")``, ``readStream`` and ``write`` with a ``payload`` column; options ``verifyChecksum``, ``startOffset``."""

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> StructType:
        return LOG_RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(RecordLogSource)
