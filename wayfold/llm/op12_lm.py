"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its bytes, A-Z lower-cased, and one end symbol. Each byte is coded as
the turns of a Huffman tree of the training bytes, so a frequent byte takes few
bit predictions. For every turn, four contexts (two, three and five bytes
back, and the whole unit so far) are hashed together with the tree's node;
their slots hold how often either turn was taken in training. The four
log-odds are added with weights that a gate selects by how well the longer
contexts are known, and an adaptive map from (byte before, mixed log-odds)
to observed shares refines the sum.

A unit is the white space before a word with the word, or the last white
space with the end. Contexts reach back to the byte before the unit and no further,
so a unit's probability depends on its own bytes alone: units are
counted once over all training texts, and scored once a batch. All counts come
from that table of units, which grows with the corpus. Weights and map are a
classifier of turns: they are fitted to all of its units,
weighed by their counts, and see each occurrence with itself
taken out of the tables. Weights are learned online, one Newton step a chunk of
units, in each task; tasks are joined by their curvature.

Slots per context grow with the table of units up to ``2**MAX_BITS``, so the
tables that go to the tasks are bounded. Token counts are not: the at most
``FREQUENT`` most frequent words go to the tasks, all others are joined. The
``FREQUENT`` most frequent units go there with their scores, all others are scored in their batch.

Defined cases: null and empty texts are an end alone; very long texts are read
whole, in a batch of their own; repeated rows weigh as often as they stand
there and each get their row; with nothing to learn from, every turn has one half and
every token the base score 0; an empty table gives an empty result; only the id, the text and
``extra`` are read, so other columns' names do not matter. Tokens are
told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import Words, bounded, materialize, mix, release, scratch, span_codes, stored

END = 255  # no byte of UTF-8
ORDERS = (2, 3, 5)
PREDICTORS = len(ORDERS) + 1
INPUTS = PREDICTORS + 1  # and a constant
MIN_BITS, MAX_BITS = 16, 22
BLOCK = 16  # log2 of the slots that are merged and sent as one
FREQUENT = 1 << 20
#: Bytes of text of a batch, and bytes of units of a chunk.
BATCH, CHUNK = 4 << 20, 1 << 15
#: Added to either count.
PRIOR = 0.4
#: Counts are held as the largest of these levels that is not above them: whole up to 63, then in steps of 15 %.
LEVEL = np.array([*range(64), *(64 * 1.15 ** np.arange(192))])
_PAIR = np.arange(1 << 16)
_LOW, _HIGH = LEVEL[_PAIR >> 8], LEVEL[_PAIR & 255]
#: A pair of counts as one byte: how well it is known (never seen, up to three times, more) and log-odds in fifths.
GRADES = 85
_KNOWN = ((_LOW + _HIGH) > 0).astype(int) + ((_LOW + _HIGH) > 3)
_BYTE = (_KNOWN * GRADES + np.clip(np.rint(5 * np.log((_HIGH + PRIOR) / (_LOW + PRIOR))), -42, 42) + 42).astype(np.uint8)
ODDS = ((np.arange(256) % GRADES - 42) / 5).astype(np.float32)
KNOWN = np.minimum(np.arange(256) // GRADES, 2).astype(np.uint8)
GATES = 27
#: A turn's pair with one occurrence of it taken out, where the count is whole; turn 0 first.
_WITHOUT = np.concatenate([np.where((_PAIR >> 8 > 0) & (_PAIR >> 8 < 64), _PAIR - 256, _PAIR), np.where((_PAIR & 255 > 0) & (_PAIR & 255 < 64), _PAIR - 1, _PAIR)])
_BYTE_WITHOUT = _BYTE[_WITHOUT]
START, RIDGE = 0.3, 10.0
BUCKETS, SPREAD, TRUST = 129, 8.0, 20.0  # log-odds -8 to 8 in eighths
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Units:
    """Units of a batch of texts: distinct ones as flat bytes, each after the byte before it, and where they stand."""

    def __init__(self, column: pa.Array):
        words = Words(column, word=~_SPACE)
        n = np.diff(words.first)
        owner = np.repeat(np.arange(len(n)), n)
        # the texts end to end with an end after each, and one before the first
        ends = words.offsets[1:] + np.arange(1, len(n) + 1)
        flat = np.full(len(words.raw) + len(n) + 1, END, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[0] = False
        inner[ends] = False
        flat[inner] = words.raw
        place = np.concatenate([words.end + owner, ends])  # places in flat just at or after a unit's last byte
        order = np.argsort(place, kind="stable")
        stop = place[order] + 1
        start = np.concatenate([[0], stop[:-1] - 1]) if len(stop) else stop
        self.token = np.concatenate([words.code, np.zeros(len(n), np.uint64)])[order].view(np.int64)
        self.first = np.concatenate([[0], np.cumsum(n + 1)])  # of each text's units
        # a unit's code, from its word's, the white space before it and the byte before that
        code = _unit_codes(self.token, flat, start, np.concatenate([words.start + owner + 1, ends])[order])
        self.code, at, self.of, self.count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        self.own = self.token[at]
        self.bytes, self.offsets = _cut(flat, start[at], stop[at])


def _unit_codes(token: np.ndarray, flat: np.ndarray, start: np.ndarray, gap_stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit that begins at ``start`` with the byte before it; its white space ends at ``gap_stop``."""
    return mix(token.view(np.uint64) + mix(span_codes(flat, start + 1, gap_stop) + flat[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _cut(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = stop - start
    offsets = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])], offsets


class Tree:
    """A Huffman tree of bytes: each byte's nodes and turns, root first."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, (s,)) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for turn, side in enumerate((left, right)):
                for s in side:
                    paths[s].append((node, turn))
            heapq.heappush(heap, (a + b, 256 + node, left + right))
        self.length = np.array([len(p) for p in paths])
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.node = np.array([n for p in paths for n, _ in reversed(p)], np.uint32) * np.uint32(0x9E3779B1)
        self.turn = np.array([t for p in paths for _, t in reversed(p)])


class Turns:
    """The turns of a chunk of units: how many each unit has, the turn taken, the byte before, the slot in each predictor's table."""

    def __init__(self, tree: Tree, flat: np.ndarray, offsets: np.ndarray, bits: int):
        size = np.diff(offsets)
        within = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
        coded = np.flatnonzero(within)
        length = tree.length[flat]
        length[offsets[:-1]] = 0
        self.count = np.add.reduceat(length, offsets[:-1])
        length = length[coded]
        symbol = flat[coded]
        last = np.cumsum(length)
        at = np.repeat(np.arange(len(symbol)), length)
        path = np.arange(len(at)) + np.repeat(tree.offset[symbol] - (last - length), length)
        self.turn = tree.turn.take(path, mode="clip")
        self.before = np.repeat(flat[coded - 1].astype(np.int64), length)
        node = tree.node.take(path, mode="clip")
        self.slots = []
        for context in self._contexts(flat, within, coded, offsets):
            slot = context.take(at, mode="clip")
            slot ^= node
            slot *= np.uint32(0x2C1B3C6D)
            slot ^= slot >> np.uint32(15)
            slot *= np.uint32(0x297A2D39)
            slot >>= np.uint32(32 - bits)
            self.slots.append(slot.astype(np.int64))

    @staticmethod
    def _contexts(flat, within, coded, offsets):
        wide = flat.astype(np.uint64)
        code = np.zeros(len(flat), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            shifted = np.zeros(len(flat), np.uint64)
            shifted[back:] = wide[:-back] + np.uint64(1)
            shifted[within < back] = 0
            code = code * np.uint64(257) + shifted
            if back in ORDERS:
                yield _folded(code[coded], back)
        # the unit so far, as a polynomial in an odd number modulo 2**64
        base = np.uint64(0xD1342543DE82EF95)
        power = np.cumprod(np.full(len(flat) + 1, base))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(power[:-1] * (wide + np.uint64(1)))])
        inverse = np.cumprod(np.full(len(flat) + 1, np.uint64(pow(int(base), -1, 1 << 64))))
        start = np.repeat(offsets[:-1], np.diff(offsets)) + 1  # the byte before is no part of it
        yield _folded(((total[:-1] - total[start])[coded] * inverse[start][coded]), 0)


def _folded(code: np.ndarray, seed: int) -> np.ndarray:
    code = (code + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(32)).astype(np.uint32)


def _chunks(flat: np.ndarray, offsets: np.ndarray):
    """Units from ``low`` to ``high`` of about ``CHUNK`` bytes; a longer one comes alone."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        yield low, high, flat[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


@dataclass
class Model:
    """What is learned: the tree, pairs of counts by predictor and slot, weights by gate, the adaptive map."""

    tree: Tree
    bits: int
    tables: list[np.ndarray]
    weights: np.ndarray
    map: np.ndarray

    def without(self, turns: Turns) -> tuple[list[np.ndarray], np.ndarray]:
        """Grades of each predictor with the occurrence itself taken out, and gates."""
        side = turns.turn << 16
        grades = [_BYTE_WITHOUT.take(t.take(s, mode="clip") + side, mode="clip") for t, s in zip(self.tables, turns.slots, strict=True)]
        return grades, _gate(grades)

    def mixed(self, grades: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        total = self.weights[:, -1].astype(np.float32)[gate]
        for k, grade in enumerate(grades):
            total += (self.weights[:, k, None] * ODDS).astype(np.float32).ravel().take(gate * 256 + grade, mode="clip")
        return total


class Reader:
    """A model laid out for scoring: grades by slot, weighed log-odds by gate and grade, costs by bucket."""

    def __init__(self, model: Model):
        self.tree, self.bits = model.tree, model.bits
        self.tables = [_BYTE[t] for t in model.tables]
        self.weighed = [(model.weights[:, k, None] * ODDS).astype(np.float32).ravel() for k in range(PREDICTORS)]
        self.weighed[0] += np.repeat(model.weights[:, -1].astype(np.float32), 256)
        self.cost = np.log(np.stack([1 - model.map, model.map], axis=2)).ravel()

    def unit_scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each unit's probability."""
        out = np.zeros(len(offsets) - 1)
        for low, high, part, ends in _chunks(flat, offsets):
            turns = Turns(self.tree, part, ends, self.bits)
            grades = [t.take(s, mode="clip") for t, s in zip(self.tables, turns.slots, strict=True)]
            gate = _gate(grades) * 256
            odds = self.weighed[0].take(gate + grades[0], mode="clip")
            for weighed, grade in zip(self.weighed[1:], grades[1:], strict=True):
                odds += weighed.take(gate + grade, mode="clip")
            cost = self.cost.take((turns.before * BUCKETS + _bucket(odds)) * 2 + turns.turn, mode="clip")
            out[low:high] = np.add.reduceat(cost, np.cumsum(turns.count) - turns.count)
        return out


def _gate(grades: list[np.ndarray]) -> np.ndarray:
    """By how well the three longer contexts are known."""
    a, b, c = (KNOWN.take(g, mode="clip") for g in grades[-3:])
    return ((a * 3 + b) * 3 + c).astype(np.int64)


def _bucket(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds * np.float32(SPREAD) + np.float32(BUCKETS // 2 + 0.5), 0, BUCKETS - 1).astype(np.int64)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8), offsets - offsets[0]


def unit_counts(docs: DataFrame, text: str) -> DataFrame:
    """``unit, token, n``: every unit of the texts, with the byte before it, and how often it stands there."""

    def run(batches):
        for batch in bounded(batches, 0, BATCH):
            u = Units(batch.column(0))
            unit = pa.Array.from_buffers(pa.binary(), len(u.count), [None, pa.py_buffer(u.offsets.astype(np.int32)), pa.py_buffer(u.bytes)])
            yield pa.RecordBatch.from_arrays([unit, pa.array(u.own), pa.array(u.count)], ["unit", "token", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "unit binary, token long, n long")
    return rows.groupBy("unit", "token").agg(F.sum("n").alias("n"))


def byte_counts(units: DataFrame) -> tuple[np.ndarray, int, int]:
    """How often each byte is coded, how many bytes the units have, and how many they are."""

    def run(batches):
        total, size, many = np.zeros(256, np.int64), 0, 0
        for batch in batches:
            flat, offsets = _spans(batch.column(0))
            weight = np.repeat(np.asarray(batch.column(1)), np.diff(offsets))
            weight[offsets[:-1]] = 0
            total += np.bincount(flat, weight, 256).astype(np.int64)
            size += len(flat)
            many += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(258)]), pa.array([*total.tolist(), size, many])], ["byte", "n"])

    rows = units.select("unit", "n").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    said = {r.byte: r.n for r in rows}
    return np.array([said.get(k, 0) for k in range(256)]), said.get(256, 0), said.get(257, 0)


def _tables(units: DataFrame, tree: Tree, bits: int) -> list[np.ndarray]:
    """Pairs of counts of every slot: tasks count, blocks of slots are merged in a stream."""
    size = 1 << min(BLOCK, bits)

    def count(batches):
        total = np.zeros((PREDICTORS, 2 << bits), np.float32)  # of one task's distinct units, and kept in steps of 15 %
        for batch in batches:
            n = np.asarray(batch.column(1)).astype(np.float32)
            for low, high, part, ends in _chunks(*_spans(batch.column(0))):
                turns = Turns(tree, part, ends, bits)
                weight = np.repeat(n[low:high], turns.count)
                for k, slot in enumerate(turns.slots):
                    np.add.at(total[k], slot * 2 + turns.turn, weight)
        for k in range(PREDICTORS):
            for block, part in enumerate(total[k].reshape(-1, 2 * size)):
                some = np.flatnonzero(part)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([some.astype(np.uint32).tobytes()]), pa.array([part[some].tobytes()])], ["k", "block", "place", "n"])

    def merge(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = held.setdefault((r["k"], r["block"]), np.zeros(2 * size))
                total[np.frombuffer(r["place"], np.uint32)] += np.frombuffer(r["n"], np.float32)
        for (k, block), total in held.items():
            level = (np.searchsorted(LEVEL, total, "right") - 1).astype(np.uint16).reshape(-1, 2)
            pair = level[:, 0] << np.uint16(8) | level[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([pair.tobytes()])], ["k", "block", "pairs"])

    parts = units.select("unit", "n").mapInArrow(count, "k int, block int, place binary, n binary")
    tables = [np.zeros(1 << bits, np.uint16) for _ in range(PREDICTORS)]
    merged = parts.repartition("k", "block").mapInArrow(merge, "k int, block int, pairs binary")
    for r in merged.collect():  # at most PREDICTORS * 2**MAX_BITS pairs
        tables[r.k][r.block * size : (r.block + 1) * size] = np.frombuffer(r.pairs, np.uint16)
    return tables


def _summed(units: DataFrame, cells: int, run) -> np.ndarray:
    """The sum over tasks of a vector of ``cells`` numbers."""

    def spread(batches):
        total = run(batches)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "value"])

    out = np.zeros(cells)
    for r in units.select("unit", "n").mapInArrow(spread, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


def _learn_weights(units: DataFrame, model: Model) -> np.ndarray:
    """Weights by online Newton steps in each task, joined by the tasks' curvature."""
    shared = units.sparkSession.sparkContext.broadcast(model)
    start = np.full((GATES, INPUTS), START)
    start[:, -1] = 0

    def run(batches):
        m = shared.value
        m = Model(m.tree, m.bits, m.tables, start.copy(), m.map)
        curve = np.zeros((GATES, INPUTS, INPUTS))
        for batch in batches:
            n = np.asarray(batch.column(1)).astype(np.float64)
            for low, high, part, ends in _chunks(*_spans(batch.column(0))):
                turns = Turns(m.tree, part, ends, m.bits)
                grades, gate = m.without(turns)
                # turns by gate, so that each gate's sums are one product
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
                x = np.ones((INPUTS, len(order)))
                for k, grade in enumerate(grades):
                    x[k] = ODDS.take(grade.take(order), mode="clip")
                p = 1 / (1 + np.exp(-m.mixed(grades, gate)[order].astype(np.float64)))
                weight = np.repeat(n[low:high], turns.count)[order]
                error, bent = (turns.turn[order] - p) * weight, x * (p * (1 - p) * weight)
                slope = np.zeros((GATES, INPUTS))
                for g in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[g], cuts[g + 1])
                    slope[g] = x[:, own] @ error[own]
                    curve[g] += bent[:, own] @ x[:, own].T
                m.weights += np.linalg.solve(curve + RIDGE * np.eye(INPUTS), slope[:, :, None])[:, :, 0]
        return np.concatenate([curve.ravel(), (curve @ (m.weights - start)[:, :, None]).ravel()])

    total = _summed(units, GATES * INPUTS * (INPUTS + 1), run)
    shared.unpersist()
    curve = total[: GATES * INPUTS * INPUTS].reshape(GATES, INPUTS, INPUTS)
    pull = total[GATES * INPUTS * INPUTS :].reshape(GATES, INPUTS, 1)
    return start + np.linalg.solve(curve + RIDGE * np.eye(INPUTS), pull)[:, :, 0]


def _learn_map(units: DataFrame, model: Model) -> np.ndarray:
    """Share of turn 1 by byte before and bucket of mixed log-odds, drawn to the bucket's own where little was seen."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        total = np.zeros(256 * BUCKETS * 2)
        for batch in batches:
            n = np.asarray(batch.column(1)).astype(np.float64)
            for low, high, part, ends in _chunks(*_spans(batch.column(0))):
                turns = Turns(m.tree, part, ends, m.bits)
                at = turns.before * BUCKETS + _bucket(m.mixed(*m.without(turns)))
                np.add.at(total, at * 2 + turns.turn, np.repeat(n[low:high], turns.count))
        return total

    seen = _summed(units, 256 * BUCKETS * 2, run).reshape(256, BUCKETS, 2)
    shared.unpersist()
    return (seen[:, :, 1] + TRUST * _centre()) / (seen.sum(axis=2) + TRUST)


def _centre() -> np.ndarray:
    return 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / SPREAD))


def _least(sizes: list[Row]) -> int | None:
    """The lowest ``size`` down to which there are at most ``FREQUENT`` rows; None if the highest has more."""
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.size):
        held += r.rows
        if held > FREQUENT:
            break
        least = r.size
    return least


def _size() -> Column:
    return F.floor(F.log2("n") * 16).alias("size")


def _frequent_units(units: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the at most ``FREQUENT`` most frequent units, ascending, and their scores."""
    least = _least(units.groupBy(_size()).agg(F.count("*").alias("rows")).collect())  # some hundred
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    shared = units.sparkSession.sparkContext.broadcast(Reader(model))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _spans(batch.column(0))
            solid = ~_SPACE[flat]
            solid[offsets[:-1]] = False
            places = np.flatnonzero(solid)
            code = _unit_codes(np.asarray(batch.column(1)), flat, offsets[:-1], places[np.searchsorted(places, offsets[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(shared.value.unit_scores(flat, offsets))], ["code", "score"])

    found = units.where(_size() >= least).select("unit", "token").mapInArrow(run, "code long, score double").toArrow()  # at most FREQUENT rows
    shared.unpersist()
    code = np.asarray(found.column(0)).view(np.uint64)
    order = np.argsort(code)
    return code[order], np.asarray(found.column(1))[order]


def unit_scores(u: Units, reader: Reader, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each unit of a batch: read from the frequent ones, else computed."""
    code, score = frequent
    if not len(code):
        return reader.unit_scores(u.bytes, u.offsets)
    at = np.minimum(np.searchsorted(code, u.code), len(code) - 1)
    out = score[at]
    rest = np.flatnonzero(code[at] != u.code)
    out[rest] = reader.unit_scores(*_cut(u.bytes, u.offsets[rest], u.offsets[rest + 1]))
    return out


@dataclass
class Scorer:
    """A model, the scores of the frequent units, and the training tokens: how many, how many distinct, the counts of the frequent ones and those of the others."""

    model: Model
    units: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int
    frequent: tuple[np.ndarray, np.ndarray]
    others: DataFrame

    @property
    def whole(self) -> float:
        """What a token's count and a half are divided by."""
        return self.tokens + 0.5 * (self.distinct + 1)


def train(docs: DataFrame, text: str = "text") -> Scorer:
    """Learn from all rows."""
    with scratch("lm"):
        units = stored(unit_counts(docs, text).sortWithinPartitions("token", "unit"))  # an order that does not depend on the run
    tokens = materialize(units.groupBy("token").agg(F.sum("n").alias("n")).select("*", _size()))
    sizes = tokens.groupBy("size").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()  # some hundred
    least = _least(sizes)
    often = tokens.where(F.col("size") >= least) if least is not None else tokens.limit(0)
    top = often.select("token", "n").orderBy("token").toArrow()  # at most FREQUENT rows
    frequent = (np.asarray(top.column(0)), np.asarray(top.column(1)))
    counts, size, _ = byte_counts(units)
    bits = min(MAX_BITS, max(MIN_BITS, size.bit_length()))
    tree = Tree(counts)
    flat = np.tile(_centre(), (256, 1))
    start = np.full((GATES, INPUTS), START)
    start[:, -1] = 0
    model = Model(tree, bits, _tables(units, tree, bits), start, flat)
    model.weights = _learn_weights(units, model)
    model.map = _learn_map(units, model)
    scored = _frequent_units(units, model)
    release(docs, "lm")
    return Scorer(model, scored, sum(r.n for r in sizes), sum(r.rows for r in sizes), frequent, tokens.where(F.col("size") < least).select("token", "n") if least is not None else tokens.select("token", "n"))


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the ``extra`` columns, ``n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    extra = extra or {}
    shared = docs.sparkSession.sparkContext.broadcast((Reader(scorer.model), scorer.units, scorer.frequent))
    whole = scorer.whole

    def run(batches):
        reader, frequent, (token, count) = shared.value
        for batch in bounded(batches, -1, BATCH):
            u = Units(batch.column(batch.num_columns - 1))
            each = unit_scores(u, reader, frequent)
            at = np.minimum(np.searchsorted(token, u.own), max(0, len(token) - 1))
            known = token[at] == u.own if len(token) else np.zeros(len(u.own), bool)
            own = np.where(known, np.log10((count[at] + 0.5) / whole), 0) if len(token) else np.zeros(len(u.own))
            first = u.first[:-1]
            rare = ~known[u.of]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[u.first].astype(np.int32)), pa.array(u.token[rare]))
            size = np.add.reduceat(np.diff(u.offsets)[u.of] - 1, first) - 1  # without the end
            total = np.add.reduceat(each[u.of], first) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(u.first)), pa.array(np.add.reduceat(known[u.of].astype(np.int64), first)), pa.array(np.add.reduceat(own[u.of], first)), pa.array(total), pa.array(-total * math.log2(10) / np.maximum(size, 1)), lists],
                [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "rare"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text).cast("string").alias("text"))
    fields = [T.StructField(name, kind) for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()), ("rare", T.ArrayType(T.LongType())))]
    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *fields]))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))  # once written, a number stays with its row
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    each = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / whole)
    found = rare.join(scorer.others, "token", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * each).alias("rest"))
    out = scored.join(found, "row", "left")
    return out.select(
        "doc_id", *extra, "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(scorer.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte"
    )
