"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the 4-, 6- and 8-byte grams of its folded text (non-word
bytes read as a space), hashed to 2**20 places; none of them is left out. A
place that occurs c times in a text of n words has the rate c / (n + SMOOTH), in
units of ``RATE``. Each place j has the ratio r_j = log((p_j / |p|) / (q_j /
|q|)) of the smoothed rate sums in the two classes, and logistic regression with
a ridge penalty is fitted to the rates scaled by r_j, over the places of both
signs.

Fitting takes at most ``TRAIN_ROWS`` labelled rows in expectation, drawn by a
hash of the row key. Their rates are written once to the shared folder; sums and
gradients are added up by tasks, and the driver holds only vectors of 2**20
numbers (limited-memory quasi-Newton steps). Every row is scored on its whole text.

Defined cases: null and empty texts get the score of the intercept; very long
texts are read in parts; rows without a label are not learned from; repeated rows
weigh as often as they stand there; equal texts have equal scores; with fewer than two classes to learn
from, every score is near the class that was seen (0 without rows); other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import _WORD, arrow_rows, bounded, fold, release, scratch, stored, text_bytes

TRAIN_ROWS = 12_000
PART_ROWS = 2_000
SLICE = 128
ORDERS = (4, 6, 8)
BITS = 20
SIZE = 1 << BITS
SMOOTH = 20
RATE = 0.01
RIDGE = 1e-4
STEPS = 10
MEMORY = 6
CUTOFF = 0.7
CHUNK = 1 << 19
_SPACE = np.where(_WORD, np.arange(256), 32).astype(np.uint8)


def _places(x: np.ndarray, order: int) -> np.ndarray:
    """The hashed place of the gram that begins at each byte."""
    octets = np.lib.stride_tricks.as_strided(np.concatenate([x, np.zeros(8, np.uint8)]), (len(x), 8), (1, 1))
    gram = np.ascontiguousarray(octets).view(np.uint64)[:, 0]
    if order < 8:
        gram &= np.uint64((1 << 8 * order) - 1)
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
    return gram >> np.uint64(64 - BITS)


def _parts(x: np.ndarray, offsets: np.ndarray):
    """(text, place) of every gram, by part of the bytes and by order."""
    for low in range(0, len(x), CHUNK):  # grams that begin in this part
        part = x[low : low + CHUNK + 8]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, low, min(low + CHUNK, len(x)))))
        left = offsets[doc + 1] - np.arange(low, low + len(doc))
        for order in ORDERS:
            fits = left >= order
            yield doc[fits], _places(part, order)[: len(doc)][fits]


def _unit(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What one occurrence adds to a place's rate in each text."""
    word = x != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = offsets[:-1][offsets[:-1] < len(x)]
    begins[starts] = word[starts]
    words = np.concatenate([[0], np.cumsum(begins)])
    return 1 / (RATE * (words[offsets[1:]] - words[offsets[:-1]] + SMOOTH))


def rates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (text, place, rate) triples of a batch, by text and place."""
    x = _SPACE[fold(raw, latin=True)]
    found = [doc << BITS | place.astype(np.int64) for doc, place in _parts(x, offsets)]
    pair, count = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    doc = pair >> BITS
    return doc, pair & (SIZE - 1), count * _unit(x, offsets)[doc]


@dataclass
class Model:
    weight: np.ndarray  # of each hashed place, the ratio included
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = _SPACE[fold(raw, latin=True)]
        z = np.zeros(len(offsets) - 1)
        for doc, place in _parts(x, offsets):
            z += np.bincount(doc, self.weight[place], len(z))
        return 1 / (1 + np.exp(-np.clip(self.bias + z * _unit(x, offsets), -50, 50)))


def _pack(doc: np.ndarray, place: np.ndarray, rate: np.ndarray, n: int) -> list[list[bytes]]:
    """By text: places as 16-bit numbers, how many there are of each upper part, and rates as half floats."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    low, high, rate = (place & 0xFFFF).astype(np.uint16), place >> 16, rate.astype(np.float16)
    return [[low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], [np.bincount(high[a:b], minlength=SIZE >> 16).astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], [rate[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]]


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels and (text, place, rate) triples of packed rows."""
    y = np.array(batch.column(0), float)
    lows, uppers, rates_ = ([v.as_py() for v in batch.column(k)] for k in (1, 2, 3))
    upper = np.frombuffer(b"".join(uppers), np.int32).reshape(len(y), SIZE >> 16)
    place = np.frombuffer(b"".join(lows), np.uint16).astype(np.int64) + (np.repeat(np.tile(np.arange(SIZE >> 16), len(y)), upper.ravel()) << 16)
    return y, np.repeat(np.arange(len(y)), upper.sum(1)), place, np.frombuffer(b"".join(rates_), np.float16).astype(np.float64)


def _added(rows: DataFrame, make) -> np.ndarray:
    """The sum of the vectors that ``make`` yields for the batches of each part."""

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = make(batch)
            if total is None:
                total = own
            else:
                total += own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sum"])

    total: np.ndarray | float = np.float64(0)
    for part in rows.mapInArrow(run, "sum binary").toArrow().column(0):  # at most a vector for each PART_ROWS of the bounded sample
        total = total + np.frombuffer(part.as_py(), np.float32)
    return total


def minimized(evaluate, at: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """A minimum of a convex function by limited-memory quasi-Newton steps; ``evaluate`` gives value and gradient."""
    value, slope = evaluate(at)
    moves, turns = [], []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for move, turn in zip(reversed(moves), reversed(turns), strict=True):
            share = (move @ way) / (move @ turn)
            way -= share * turn
            kept.append(share)
        if moves:
            way *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for move, turn, share in zip(moves, turns, reversed(kept), strict=True):
            way += (share - (turn @ way) / (move @ turn)) * move
        step, fall = 1.0, float(way @ slope)
        while True:
            there = at - step * way
            new, after = evaluate(there)
            if new <= value - 1e-4 * step * fall or step < 1e-4:
                break
            step /= 4
        if value - new < 1e-5 * max(abs(value), 1e-3):
            return there if new < value else at
        moves, turns = [*moves, there - at][-MEMORY:], [*turns, after - slope][-MEMORY:]
        at, value, slope = there, new, after
    return at


def train(df: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, ridge: float = RIDGE) -> Model:
    """Fit on about ``rows`` labelled rows, which Spark reads, counts and adds up."""
    scope = f"fit_{uuid.uuid4().hex}"
    try:
        with scratch(scope), arrow_rows(df.sparkSession, SLICE):
            return _fit(df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), F.col(text).alias("text")), rows, ridge)
    finally:
        release(df, scope)  # the fitted model reads nothing


def _fit(known: DataFrame, rows: int, ridge: float) -> Model:
    n, ones = known.agg(F.count("*"), F.sum("y")).first()
    draw = F.xxhash64("key").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    sample = known.where(draw < min(1.0, rows / max(n, 1)))
    if not ones or ones == n:
        return Model(np.zeros(SIZE), -50.0 if not ones else 50.0)

    def extract(batches):
        for batch in bounded(batches, 1, 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in _pack(*rates(*text_bytes(batch.column(1))), batch.num_rows))], names=["y", "low", "upper", "rate"])

    spread = sample.select("y", "text").repartition(max(1, -(-min(rows, n) // PART_ROWS)))
    drawn = stored(spread.mapInArrow(extract, "y int, low binary, upper binary, rate binary"))

    def sums(batch):
        y, owner, place, rate = _unpack(batch)
        own = y[owner] == 1
        return np.concatenate([np.bincount(place[~own], rate[~own], SIZE), np.bincount(place[own], rate[own], SIZE), [len(y), y.sum()]])

    both = _added(drawn, sums)
    if not isinstance(both, np.ndarray) or both[-1] in (0, both[-2]):
        return Model(np.zeros(SIZE), 50.0 if isinstance(both, np.ndarray) and both[-1] else -50.0)
    count, share = both[-2], both[-1] / both[-2]
    q, p = both[:SIZE] + 1, both[SIZE : 2 * SIZE] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    def evaluate(w):
        sent = drawn.sparkSession.sparkContext.broadcast(((w[:-1] * ratio).astype(np.float32), float(w[-1])))

        def slope(batch):
            weight, bias = sent.value
            y, owner, place, rate = _unpack(batch)
            z = np.clip(np.bincount(owner, rate * weight[place], len(y)) + bias, -50, 50)
            err = 1 / (1 + np.exp(-z)) - y
            return np.concatenate([np.bincount(place, rate * err[owner], SIZE), [err.sum(), (np.logaddexp(0, z) - y * z).sum()]])

        total = _added(drawn, slope) / count
        sent.unpersist()
        return total[-1] + ridge / 2 * float(w[:-1] @ w[:-1]), np.append(total[:-2] * ratio + ridge * w[:-1], total[-2])

    w = minimized(evaluate, np.append(np.zeros(SIZE), np.log(share / (1 - share))))
    return Model(w[:-1] * ratio, float(w[-1]))


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, the ``extra`` columns, ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def run(batches):
        m = shared.value
        for batch in bounded(batches, -1, 1 << 19):
            score = m.score(*text_bytes(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = df.select(doc_id, *(c.alias(k) for k, c in extra.items()), text)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
