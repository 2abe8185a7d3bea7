"""Packing of tokenised examples into training sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .textvec import slices
from .tokens import TOKENIZER, bpe_tokenizer

@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit is 1 or more")


@dataclass
class Item:
    """A stretch of one example: ``owner`` is its id and token count, ``loss`` marks the tokens that bear loss, None for all."""

    owner: tuple
    start: int
    ids: np.ndarray
    loss: np.ndarray | None = None

    @property
    def size(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Item, Item]:
        parts = (slice(0, n), slice(n, None))
        a, b = (Item(self.owner, self.start + (p.start or 0), self.ids[p], None if self.loss is None else self.loss[p]) for p in parts)
        return a, b


def split_item(item: Item, limits: Limits) -> list[Item]:
    """Pieces that each fit an empty sequence: as long as the token and loss limits allow."""
    pieces = []
    while True:
        n = min(len(item.ids), limits.tokens)
        if item.loss is not None:
            over = np.cumsum(item.loss[:n]) > limits.loss
            n = int(over.argmax()) if over.any() else n
        else:
            n = min(n, limits.loss)
        if n >= len(item.ids):
            return [*pieces, item]
        head, item = item.cut(n)
        pieces.append(head)


def pack(items: list[Item], limits: Limits, *, least_cut: int = 8) -> list[list[Item]]:
    """Bins of items within ``limits``, filled one at a time.

    The next item is the one that fits and whose demand has the largest dot product with what the bin has left, both as shares of
    the limits; ties go to the earlier item. When none fits and at least ``least_cut`` tokens and a segment are left, the largest
    item left is cut to fill the gap. Items with the same demand are interchangeable, so only distinct demands are weighed.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    if any(n > most for it in items for n, most in zip(it.size, cap)):
        raise ValueError("an item exceeds an empty bin: split_item makes pieces that fit")
    groups: dict[tuple[int, int, int], list[Item]] = {}
    for it in reversed(items):
        groups.setdefault(it.size, []).append(it)
    keys = list(groups)
    demand = np.array(keys, dtype=np.float64).reshape(-1, 3)
    share = demand / cap
    alive = np.ones(len(keys), dtype=bool)
    index = {k: i for i, k in enumerate(keys)}
    bins: list[list[Item]] = []
    left, room, now, remaining = None, cap.copy(), [], len(items)

    def add(item: Item) -> None:
        nonlocal keys, demand, share, alive
        if item.size not in groups:
            groups[item.size] = []
        if item.size not in index:
            index[item.size] = len(keys)
            keys.append(item.size)
            demand = np.vstack([demand, np.array(item.size, dtype=np.float64)])
            share = np.vstack([share, np.array(item.size) / cap])
            alive = np.append(alive, True)
        groups[item.size].append(item)
        alive[index[item.size]] = True

    while remaining:
        fits = alive & (demand <= room).all(axis=1)
        if fits.any():
            score = np.where(fits, share @ (room / cap), -1.0)
            k = int(score.argmax())
            item = groups[keys[k]].pop()
            alive[k] = bool(groups[keys[k]])
            remaining -= 1
        elif now and room[0] >= least_cut and room[1] >= 1 and room[2] >= least_cut:
            k = int(np.where(alive, demand[:, 0], -1).argmax())
            whole = groups[keys[k]].pop()
            alive[k] = bool(groups[keys[k]])
            n = int(min(room[0], room[2]))
            if n >= len(whole.ids):
                n = max(1, len(whole.ids) // 2)
            item, rest = whole.cut(n)
            add(rest)
        else:
            bins.append(now)
            room, now = cap.copy(), []
            continue
        now.append(item)
        room = room - np.array(item.size)
        if room[0] < 1 or room[1] < 1:
            bins.append(now)
            room, now = cap.copy(), []
    if now:
        bins.append(now)
    return bins


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def pack_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    tokenizer: str = TOKENIZER,
    end_id: int = 0,
    with_ids: bool = True,
    batch_pieces: int = 4096,
) -> DataFrame:
    """Tokenise each row's text, end it with ``end_id``, and pack all rows into sequences within ``limits``.

    One row for each piece: the id, ``start`` and ``length`` in its row's ids, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence, and ``ids`` if ``with_ids``. Every id lies in exactly one piece; pieces of a sequence are gapless.
    Whole texts are used: what exceeds a sequence fills sequences of its own, and the rest is packed with the rests of other rows.
    Each task packs what it reads in batches of ``batch_pieces`` pieces, carrying the last open sequences over, so memory is bounded
    and no shuffle is needed; a sequence_id holds the task's number in its upper bits.
    A null text is empty (its one id is ``end_id``); null and repeated ids are packed like any; an empty table gives no rows;
    other columns are not read. Plain text bears loss throughout, so its loss limit counts like the token limit.
    """
    kind = dict(df.select(id_col).dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Item]]:
        encode = bpe_tokenizer(tokenizer).encode
        held = []
        for batch in batches:
            for part in slices(batch, 1, rows=2048, size=1 << 20):
                for key, got in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    ids = np.append(got, np.uint32(end_id))
                    held += split_item(Item((key, len(ids)), 0, ids), limits)
                    if len(held) >= batch_pieces:
                        yield held
                        held = []
        yield held

    return _packed(source, items, kind, limits, with_ids).withColumnRenamed("id", id_col).withColumnRenamed("example_tokens", "doc_tokens")


def _packed(source: DataFrame, items: Callable, kind: str, limits: Limits, with_ids: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, example_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>, loss array<boolean>" * with_ids
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        carried: list[Item] = []
        source = items(batches)
        more = next(source, None)
        while more is not None:
            held, more = carried + more, next(source, None)
            bins = pack(held, limits)
            carried = []
            if more is not None:  # the emptiest sequence may still be filled
                bins.sort(key=lambda b: -sum(len(x.ids) for x in b))
                carried = bins.pop() if bins else []
            rows = []
            for b in bins:
                offset = 0
                for it in b:
                    key, n = it.owner
                    rows.append((key, it.start, len(it.ids), _crc(it.ids), n, serial, offset) + ((it.ids.astype(np.int32), it.loss if it.loss is not None else np.ones(len(it.ids), bool)) if with_ids else ()))
                    offset += len(it.ids)
                serial += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return map_batches(source, run, schema)


def pack_conversations(
    df: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    limits: Limits = Limits(tokens=1024, segments=16, loss=768),
    tokenizer: str = TOKENIZER,
    end_id: int = 0,
) -> DataFrame:
    """Pack instruction data: a conversation's turns in order are one example, and tokens of ``loss_roles`` bear loss.

    As :func:`pack_documents`; ``loss`` tells each token's part. A null role bears no loss, a null text is empty, rows with a null
    conversation are one, equal turns are ordered by role and text, repeated rows are repeated turns; other columns are not read.
    No conversation is gathered: rows are dealt out and sorted by ranges of conversation and turn, so one that holds a third of all
    rows fills many ranges, at whose ends it is cut; where its tokens start in each range comes of one sum for a range.
    """
    kind = dict(df.select(id_col).dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.col("id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.col("role").isin(*loss_roles).alias("bears"), "text")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = bpe_tokenizer(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in slices(batch, 2, size=1 << 20):
                ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in encode(cut.column(2))]
                columns = [pa.array([part] * len(ids), pa.int32()), pa.array(range(at, at + len(ids)), pa.int64()), cut.column(0), cut.column(1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "at", "id", "bears", "n", "ids"])
                at += len(ids)

    turns = materialize(map_batches(dealt, tokenise, f"part int, at bigint, id {kind}, bears boolean, n bigint, ids binary"), "turns")
    own = Window.partitionBy("own")
    sums = turns.groupBy(F.col("id").alias("own"), F.col("part").alias("own_part")).agg(F.sum("n").alias("n_part")).select(
        "own", "own_part", F.sum("n_part").over(own).alias("total"), (F.sum("n_part").over(own.orderBy("own_part")) - F.col("n_part")).alias("before")
    )
    placed = turns.join(sums, F.col("id").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    placed = placed.select("part", "at", "id", "bears", "ids", "before", "total").repartition("part").sortWithinPartitions("part", "at")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Item]]:
        held: list[Item] = []
        now: Item | None = None
        whose = None
        for batch in batches:
            for part, _, key, bears, data, before, total in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, "<u4").astype(np.uint32)
                loss = np.full(len(ids), bears)
                if now is not None and whose == (part, key):
                    now = Item(now.owner, now.start, np.concatenate([now.ids, ids]), np.concatenate([now.loss, loss]))
                else:
                    held += [now] if now is not None else []
                    whose, now = (part, key), Item((key, total), before, ids, loss)
                *whole, now = split_item(now, limits)  # the last piece may still grow
                held += whole
                if len(held) >= 4096:
                    yield held
                    held = []
        yield held + ([now] if now is not None else [])

    return _packed(placed, items, kind, limits, True).withColumnRenamed("id", id_col)


def conversations_report(conversations: DataFrame) -> DataFrame:
    """Pieces of packed ``conversations``, each with its number of loss-bearing tokens, without the token ids."""
    packed = pack_conversations(conversations)
    return packed.withColumn("n_loss", F.size(F.filter("loss", lambda x: x)).cast("long")).drop("ids", "loss")
