"""Language-model scoring by deleted interpolation: n-gram counts of the whole corpus, mixed by context frequency.

Counting and looking up go by request and answer, so that no row is made for a token. Texts are laid out in chunks of bounded size, one
row each. A chunk asks for its distinct n-grams, as sorted hashes cut into buckets; a bucket adds up what all chunks have counted
and answers each with totals in the same order. Counts are exact whatever the frequency of a word, which counts once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .textvec import U64, mix, slices, word_hashes

_START, _END = (mix(np.array([k], dtype=U64))[0] for k in (101, 102))
#: Bits of bigram hashes; single words have 64.
PAIR_BITS = 56
CHUNK_BYTES = 1 << 22
CONTEXT_BUCKETS = 40
#: Cells of like estimates for a factor of two: within a cell estimates differ by less than 4.5 %.
CELLS = 16


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the token before, and row of each token: a row's words, then its end."""
    hashes, rows = word_hashes(column)
    n = len(column)
    out = np.full(len(hashes) + n, _END, dtype=U64)
    out[np.arange(len(hashes)) + rows] = hashes
    owner = np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = _START
    return out, before, owner


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xD6E8FEB86659FD93) + word) >> U64(64 - PAIR_BITS)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte: like bytes lie together and compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(U64)


def _chunks(df: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """``(chunk, ids, training, column)``: rows in order, their texts as one compressed Arrow column."""
    import zstandard

    kind = dict(df.select(id_col).dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, serial
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())])) as writer:
                writer.write_table(pa.table({"text": table.column(1).cast(pa.large_string())}))
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            held, size, serial = [], 0, serial + 1
            one = lambda column: pa.ListArray.from_arrays([0, len(column)], column.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([serial - 1], pa.int64()), one(table.column(0)), one(table.column(2)), pa.array([blob], pa.binary())], names=["chunk", "ids", "training", "texts"])

        for batch in batches:
            for part in slices(batch, 1, size=CHUNK_BYTES):
                held.append(part)
                size += part.column(1).nbytes
                if size >= CHUNK_BYTES:
                    yield out()
        if held:
            yield out()

    return map_batches(source, run, f"chunk bigint, ids array<{kind}>, training array<boolean>, texts binary")


def _open(blob: bytes) -> pa.Array:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().column(0).combine_chunks()


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Kind (0 for words, 1 for pairs), bits, and each token's n-gram and row."""
    word, before, rows = tokens(column)
    yield 0, 64, word, rows
    yield 1, PAIR_BITS, pair_hashes(before, word), rows


_ASKED = "chunk bigint, kind int, bucket bigint, keys binary, counts binary"


def _ask(chunks: DataFrame, bucket_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, training, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mask = np.array(training, dtype=float)
                rows = []
                for kind, bits, grams, owner in _grams(_open(blob)):
                    keys, where = np.unique(grams, return_inverse=True)
                    counts = np.bincount(where, weights=mask[owner], minlength=len(keys)).astype(U64)
                    bucket = (keys >> U64(bits - bucket_bits)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for a, b in zip(edges, [*edges[1:], len(keys)]):
                        rows.append((chunk, kind, int(bucket[a]), _planes(np.diff(keys[a:b], prepend=U64(0))), _planes(counts[a:b])))
                for at in range(0, len(rows), 256):
                    cols = zip(*rows[at : at + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "kind", "bucket", "keys", "counts"])

    return map_batches(chunks.select("chunk", "training", "texts"), run, _ASKED)


_ANSWERED = "chunk bigint, kind int, bucket bigint, totals binary, types bigint, occurrences bigint"


def _answer(asked: DataFrame) -> DataFrame:
    """Totals for each request; a bucket's types and occurrences stand in one of its rows."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_values(k), dtype=U64) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([_values(c) for c in group.column("counts").to_pylist()])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=counts.astype(float), minlength=len(distinct)).astype(U64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        totals = [_planes(total[w]) for w in np.split(where, cuts)]
        first = np.arange(len(keys)) == 0
        return pa.table({
            "chunk": group.column("chunk"), "kind": group.column("kind"), "bucket": group.column("bucket"), "totals": pa.array(totals, pa.binary()),
            "types": pa.array(np.where(first, int((total > 0).sum()), 0)), "occurrences": pa.array(np.where(first, int(total.sum()), 0)),
        })

    return asked.groupBy("kind", "bucket").applyInArrow(run, _ANSWERED)


@dataclass(frozen=True)
class Mixture:
    """Weights of pair, word and uniform estimates by bucket of the context's frequency; the corpus sizes they hold for."""

    weights: np.ndarray
    occurrences: int
    types: int
    texts: int


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of the count's base-2 logarithm."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(int) + 1, 0)


def fit_mixture(bucket: np.ndarray, n: np.ndarray, pair: np.ndarray, word: np.ndarray, uniform: float, steps: int = 100) -> np.ndarray:
    """Expectation-maximisation: by bucket, the weights that make ``n`` held-out tokens with these estimates likeliest.

    A bucket without tokens gets the weights of all together; bucket 0, whose pair estimates are all 0, no pair weight.
    """
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    estimates = np.column_stack([pair, word, np.full(len(n), uniform)])

    def em(w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        for _ in range(steps):
            share = w[at] * estimates
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            mass = np.column_stack([np.bincount(at, weights=share[:, k], minlength=size) for k in range(3)])
            total = mass.sum(axis=1, keepdims=True)
            w = np.where(total > 0, mass / np.maximum(total, 1e-300), w)
        return w

    if len(n):
        pooled = em(np.full((1, 3), 1 / 3), np.zeros(len(n), int), 1)[0]
        weights[:] = pooled
        weights = em(weights, bucket, CONTEXT_BUCKETS)
    # a little of each estimate keeps every probability above zero
    weights = 0.999 * weights + 0.001 / 3
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def _lookup(left: pa.Table, right: pa.Table) -> tuple[pa.Array, np.ndarray, dict[int, np.ndarray]]:
    """A chunk's texts, each token's row, and by kind each token's total."""
    column = _open(left.column("texts")[0].as_py())
    answers: dict[int, list] = {0: [], 1: []}
    for kind, bucket, totals in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "totals"))):
        answers[kind].append((bucket, totals))
    out, owner = {}, None
    for kind, _, grams, owner in _grams(column):
        keys, where = np.unique(grams, return_inverse=True)
        total = np.concatenate([_values(t) for _, t in sorted(answers[kind])])
        if len(total) != len(keys):
            raise ValueError("answers do not match a chunk's n-grams")
        out[kind] = total[where].astype(float)
    return column, owner, out


def _context(word_total: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How often each token's context was seen in training: the token before, or the start of a text."""
    before = np.empty_like(word_total)
    before[1:] = word_total[:-1]
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = texts
    return before


def score_texts(df: DataFrame, *, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``training`` holds and score all: one row for each row of ``df``.

    Columns: the id, ``n_tokens`` (words, in lower case for A-Z, and the end), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (log10 probability by add-one word counts), ``score`` (by the mixture). Mixture weights are learned on all training
    tokens with the token's own occurrence deleted from its counts; tokens whose estimates differ by less than 4.5 % are gathered in cells,
    by their mean estimates, of which the driver gets a bounded number. The counts themselves are exact.
    A null text is empty: its end alone; a null ``training`` is no training; null and repeated ids pass; only these columns are read.
    """
    kind = dict(df.select(id_col).dtypes)[id_col]
    chunks = materialize(_chunks(df, id_col, text_col, training), "lm-chunks")
    n_chunks, texts = chunks.agg(F.count("*"), F.coalesce(F.sum(F.size(F.filter("training", lambda x: x))), F.lit(0))).first()
    answers = materialize(_answer(_ask(chunks, max(3, int(n_chunks).bit_length()))), "lm-totals")
    sizes = {r["kind"]: (r["types"], r["occurrences"]) for r in answers.groupBy("kind").agg(F.sum("types").alias("types"), F.sum("occurrences").alias("occurrences")).collect()}
    types, occurrences = sizes.get(0, (0, 0))
    uniform = 1 / (types + 1)
    left, right = chunks.groupBy("chunk"), answers.select("chunk", "kind", "bucket", "totals").groupBy("chunk")

    def cells(a: pa.Table, b: pa.Table) -> pa.Table:
        mask = np.array(a.column("training")[0].as_py(), dtype=bool)
        _, owner, total = _lookup(a, b)
        context = _context(total[0], owner, texts)
        use = mask[owner]
        context, word, pair = context[use], total[0][use], total[1][use]
        p2 = (pair - 1) / np.maximum(context - 1, 1)
        p1 = (word - 1) / max(occurrences - 1, 1)
        cell = lambda p: np.where(p > 0, np.floor(-CELLS * np.log2(np.maximum(p, 1e-300))), -1000).astype(int)
        key = np.column_stack([context_bucket(context), cell(p2), cell(p1)])
        distinct, where = np.unique(key, axis=0, return_inverse=True)
        where = where.ravel()
        add = lambda v: pa.array(np.bincount(where, weights=v, minlength=len(distinct)))
        return pa.table({"bucket": pa.array(distinct[:, 0], pa.int32()), "c2": pa.array(distinct[:, 1], pa.int32()), "c1": pa.array(distinct[:, 2], pa.int32()), "n": add(np.ones(len(where))), "s2": add(p2), "s1": add(p1)})

    found = (
        left.cogroup(right).applyInArrow(cells, "bucket int, c2 int, c1 int, n double, s2 double, s1 double")
        .groupBy("bucket", "c2", "c1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).toArrow()
    )
    n = found.column("n").to_numpy()
    order = np.lexsort([found.column(c).to_numpy() for c in ("c1", "c2", "bucket")])
    column = lambda c: found.column(c).to_numpy()[order]
    n = column("n")
    mixture = Mixture(fit_mixture(column("bucket"), n, column("s2") / np.maximum(n, 1), column("s1") / np.maximum(n, 1), uniform), occurrences, types, texts)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        texts_, owner, total = _lookup(a, b)
        size = len(texts_)
        context = _context(total[0], owner, mixture.texts)
        weights = mixture.weights[context_bucket(context)]
        p = weights[:, 0] * total[1] / np.maximum(context, 1) + weights[:, 1] * total[0] / max(mixture.occurrences, 1) + weights[:, 2] / (mixture.types + 1)
        add = lambda v: np.bincount(owner, weights=v, minlength=size)
        ids = a.column("ids").combine_chunks()
        return pa.table({
            "id": (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten(),
            "n_tokens": pa.array(np.bincount(owner, minlength=size)),
            "n_known": pa.array(add(total[0] > 0).astype(np.int64)),
            "base_score": pa.array(add(np.log10((total[0] + 1) / (mixture.occurrences + mixture.types + 1)))),
            "score": pa.array(add(np.log10(p))),
        })

    out = left.cogroup(right).applyInArrow(score, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(occurrences).cast("long").alias("train_tokens"), "base_score", "score")


def lm_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs``, learned from those not held out: a row for each row; null and empty texts are their end alone.

    A null id is in training, as no remainder holds it out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score_texts(docs, training=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
