"""Quality classifier: ordinal regression with cumulative links on hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches
from .textvec import LOWER, SPACES, U64, hash_spans, text_bytes, words

BITS = 14
#: A document is kept when the probability of a good grade is at least this.
KEEP_TAIL = 0.5
_SALT = {"word": 1, "shape": 2, "pair": 3, "again": 4}


def _shape_classes() -> np.ndarray:
    """Each byte's class: small letters and what isn't ASCII, capitals, digits, and every other character by itself."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = ord("a")
    out[65:91], out[48:58] = ord("A"), ord("0")
    return out


_CLASS = _shape_classes()


def features(column: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the indices and weights of its hashed features.

    Features are words without case, word shapes (classes of characters, runs as one), pairs of neighbouring shapes, and whether a
    word repeats the one before. Each kind's counts are square-rooted and scaled to length 1, so any text length compares.
    """
    data, offsets = text_bytes(column)
    starts, ends, rows = words(data, offsets, SPACES)
    hashes = hash_spans(LOWER[data], starts, ends, _SALT["word"])
    classes = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = hash_spans(classes[keep], place[starts], place[ends], _SALT["shape"])
    same = np.zeros(len(rows), bool)
    same[1:] = rows[1:] == rows[:-1]
    pair = np.where(same, shape * U64(31) + np.roll(shape, 1) + U64(_SALT["pair"]), shape)
    again = same & (hashes == np.roll(hashes, 1))
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    mask = U64((1 << bits) - 1)
    kinds = [(h & mask).astype(np.int64) for h in (hashes, shape, pair ^ (pair >> U64(29)), np.where(again, U64(_SALT["again"] * 2654435761), U64(7)))]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        indices, weights = [], []
        for kind in kinds:
            i, n = np.unique(kind[a:b], return_counts=True)
            w = np.sqrt(n)
            indices.append(i)
            weights.append(w / max(np.sqrt((w * w).sum()), 1e-12))
        out.append((np.concatenate(indices), np.concatenate(weights)))
    return out


@dataclass
class OrdinalModel:
    """``P(grade <= k) = sigmoid(cuts[k] - weights.x)``: shared weights, ordered cuts, one fewer than grades.

    Grades from number ``good`` on are those of the tail probability.
    """

    grades: list[float]
    weights: np.ndarray
    cuts: np.ndarray
    bits: int = BITS
    good: int = 1

    def proba(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.array([float((self.weights[i] * v).sum()) for i, v in rows])
        below = np.ones((len(rows), len(self.grades)))
        below[:, :-1] = _sigmoid(self.cuts[None, :] - z[:, None])
        return np.diff(below, axis=1, prepend=0.0)

    def tail(self, p: np.ndarray) -> np.ndarray:
        """The probability of a good grade, of :meth:`proba`'s rows."""
        return p[:, self.good :].sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, *, bits: int = BITS, l2: float = 1e-4, steps: int = 150, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam over all rows at once.

    Cuts stay ordered: the first is free and each other adds a positive step. With a single grade the model always gives it.
    """
    grades = sorted(set(ratings.tolist()))
    k = np.searchsorted(grades, ratings)
    n, m = len(rows), len(grades) - 1
    w = np.zeros(1 << bits)
    if m < 1:
        return OrdinalModel(grades, w, np.zeros(0), bits)
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    share = np.clip(np.cumsum(np.bincount(k, minlength=m + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    theta = np.concatenate([w, free])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, free = theta[: 1 << bits], theta[1 << bits :]
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(owner, weights=value * w[index], minlength=n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = _sigmoid(edge[k + 1] - z), _sigmoid(edge[k] - z)
        up, low = np.where(k == m, 1.0, up), np.where(k == 0, 0.0, low)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_z = (d_up - d_low) / n  # of the negative log-likelihood
        g_w = np.bincount(index, weights=value * g_z[owner], minlength=1 << bits) + l2 * w
        g_cut = -np.bincount(np.minimum(k, m - 1), weights=np.where(k < m, d_up, 0), minlength=m) / n
        g_cut += np.bincount(np.maximum(k - 1, 0), weights=np.where(k > 0, d_low, 0), minlength=m) / n
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w, free = theta[: 1 << bits], theta[1 << bits :]
    return OrdinalModel(grades, w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), bits)


def split_lowest(rows: list, ratings: np.ndarray, parts: list[list], *, bits: int = BITS) -> np.ndarray:
    """Ratings with the lowest one graded further: a text that has a good part lies halfway to the next rating.

    ``parts`` has the features of each lowest-rated text's parts, in the order of those texts. Whether a part is good says a model that
    was fitted on the other half of the texts.
    """
    lowest = np.flatnonzero(ratings == ratings.min())
    above = ratings[ratings > ratings.min()]
    if not len(above):
        return ratings
    out = ratings.copy()
    half = np.arange(len(rows)) % 2
    for h in (0, 1):
        fitted = np.flatnonzero(half != h)
        model = fit_ordinal([rows[i] for i in fitted], ratings[fitted], bits=bits)
        if len(model.grades) < 2 or model.grades[0] != ratings.min():
            return ratings
        for i, own in zip(lowest, parts):
            if half[i] == h and own and (model.tail(model.proba(own)) >= KEEP_TAIL).any():
                out[i] = (ratings.min() + above.min()) / 2
    return out


_PARTS = 4


def fit_quality(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "rating", max_rows: int = 10_000, bits: int = BITS) -> OrdinalModel:
    """Fit on rated ids of ``docs``: at most ``max_rows`` of them (a bounded sample, the first by a hash of the id), collected as features.

    Texts of the lowest rating are graded further: those with a good quarter lie halfway to the next rating (:func:`split_lowest`), and
    the tail is that of the ratings above the lowest. Null ids, texts and ratings are left out; an id rated twice counts with its
    lowest rating, an id with several texts once, with the first text in order. Without any rated row the model has the single grade 0.
    """
    chosen = (
        ratings.where(F.col(id_col).isNotNull() & F.col(rating_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col(rating_col).cast("double")).alias("rating"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = source.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("rating").alias("rating"), F.min("text").alias("text"))
    lowest = chosen.agg(F.min("rating")).first()[0]

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "part": [], "rating": [], "i": [], "v": []}
        for key, rating, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.split() if rating == lowest else []
            cuts = [len(words) * k // _PARTS for k in range(_PARTS + 1)]
            parts = [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:]) if b - a >= 5]
            for k, (i, v) in enumerate(features(pa.array([text, *parts]), bits)):
                for name, value in (("id", key), ("part", k), ("rating", rating), ("i", i.astype("<u4").tobytes()), ("v", v.astype("<f4").tobytes())):
                    out[name].append(value)
        return out

    kind = dict(sample.dtypes)["id"]
    found = map_arrow(sample.select("id", "rating", "text"), run, f"id {kind}, part int, rating double, i binary, v binary", rows=128).toArrow()
    if not len(found):
        return OrdinalModel([0.0], np.zeros(1 << bits), np.zeros(0), bits)
    keys, part, rating = (found[c].to_pylist() for c in ("id", "part", "rating"))
    vectors = [(np.frombuffer(i.as_buffer(), "<u4").astype(np.int64), np.frombuffer(v.as_buffer(), "<f4").astype(float)) for i, v in zip(found["i"], found["v"])]
    parts: dict = {}
    for k, p, x in zip(keys, part, vectors):
        if p:
            parts.setdefault(k, []).append(x)
    order = sorted((r for r in range(len(keys)) if not part[r]), key=lambda r: keys[r])  # the same sums whatever order rows come in
    rows, given = [vectors[r] for r in order], np.array([rating[r] for r in order])
    graded = split_lowest(rows, given, [parts.get(keys[r], []) for r in order if rating[r] == given.min()], bits=bits)
    model = fit_ordinal(rows, graded, bits=bits)
    model.good = sum(g < min((x for x in set(given.tolist()) if x > given.min()), default=np.inf) for g in model.grades) or 1
    return model


def score_quality(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``expected_grade``, and ``tail``, the probability of a rating above the lowest, both double.

    Texts are read whole; null and empty texts get what the cuts alone give. Null and repeated ids pass; no other column is read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    grades = np.array(model.grades)

    def run(batch: pa.RecordBatch) -> dict:
        p = model.proba(features(batch.column(1), model.bits))
        return {"id": batch.column(0), "expected_grade": pa.array(p @ grades), "tail": pa.array(model.tail(p))}

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, expected_grade double, tail double", rows=256)
    return out.withColumnRenamed("id", id_col)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the quality in ``labels`` alone: 0 for low, 1 for good; toxicity is another operator's."""
    return labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("rating"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grade and tail of each row of ``docs`` by a model of its rated rows, and whether it is kept.

    A row for each row, whatever its id; null and empty texts get what the cuts alone give; without labels every tail is 0.
    """
    out = score_quality(docs, fit_quality(docs, grades(labels)))
    return out.withColumn("keep", F.col("tail") >= KEEP_TAIL)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = KEEP_TAIL) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``tail`` reaches ``threshold``."""
    model = fit_quality(docs, grades(labels))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tail = model.tail(model.proba(features(part.column(names.index("text")), model.bits)))
                yield part.filter(pa.array(tail >= threshold))

    return map_batches(docs, run, docs.schema)
