"""Language identification by prediction by partial matching (PPM).

For each language the training texts give byte counts in contexts of up to
three bytes. A symbol seen in a context costs its share of the context's
total; an unseen one costs the escape (method C) and is coded one order lower,
down to one of 256 bytes. The statistics are frozen, so a text's code length
is a sum over its bytes, and the cheapest language wins.

A language has a context of order two or three if it has seen it ``MIN_COUNT``
times (the tree has variable order), so its code lengths depend on its own texts alone.
Languages share tables while these stay under ``GROUP_BYTES``; each group of
languages is one pass over a text. So the model that goes to the tasks grows with the
sum of the languages' contexts, never with their product, and there is no
most number of languages. Code lengths are whole numbers of 2**-16 bits, so
sums depend neither on the order of adding nor on the groups.

Training takes at most ``TRAIN_ROWS`` rows of each language in expectation,
drawn by a hash of the row key; every row is scored on its whole text.

Defined cases: null, empty and letterless text is ``und`` with score 0; with
nothing to learn from, every text is ``und``; ties go to the smaller name; very
long texts are read in parts, whole; repeated rows weigh as often as they stand
there and each get their row; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import bounded, fold, text_bytes

TRAIN_ROWS = 2_000
MIN_COUNT = 2
UNIT = 1 << 16
GROUP_BYTES = 24 << 20
CHUNK = 1 << 21
_NEWLINE = 10


def _contexts(x: np.ndarray, offsets: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes one, two and three places before each byte; ``blank`` before a text's start."""
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    out = []
    for _ in range(3):
        p = np.empty_like(x)
        p[1:] = x[:-1]
        p[starts] = blank
        out.append(p)
        x = p
    return tuple(out)


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Counts of (three bytes of context, byte) by language: ``lang, gram, n``."""

    def run(batches):
        for batch in bounded(batches, 1):
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for name in sorted({x for x in names if x is not None}):
                raw, offsets = text_bytes(column.filter(pa.array([x == name for x in names])))
                x = fold(raw, latin=True)
                if not len(x):
                    continue
                a, b, c = (p.astype(np.int64) for p in _contexts(x, offsets, _NEWLINE))
                gram, n = np.unique(c << 24 | b << 16 | a << 8 | x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    parts = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    return np.where(total == 0, lower, np.where(n > 0, n / whole, distinct / whole * lower))


class Tables:
    """Code lengths of a few languages over shared context nodes: ``cost[node * size + symbol, language]``."""

    def __init__(self, langs: int, owner: np.ndarray, gram: np.ndarray, count: np.ndarray, min_count: int):
        used = np.unique(np.concatenate([[_NEWLINE], *(gram >> s & 255 for s in (0, 8, 16, 24))])).astype(np.int64)
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used))
        self.size = size = len(used) + 1  # the last symbol stands for all unseen bytes
        s, a, b, c = (self.symbol[gram >> k & 255].astype(np.int64) for k in (0, 8, 16, 24))
        (pair, pair_at), (deep, deep_at) = (_kept(x, owner, count, langs, min_count) for x in (b * size + a, (c * size + b) * size + a))
        short = size + len(pair)  # nodes of orders one and two
        self.near = np.tile(np.arange(size, dtype=np.int32), size)  # by default the node of order one
        self.near[pair] = size + np.arange(len(pair))
        self.far = np.repeat(np.arange(short, dtype=np.int32), size)
        self.far[self.near[deep % (size * size)].astype(np.int64) * size + deep // (size * size)] = short + np.arange(len(deep))
        self.cost = np.empty((short + len(deep), size, langs), np.int32)
        for k in range(langs):
            own = owner == k
            w = count[own].astype(float)

            def seen(at: np.ndarray, n: int) -> np.ndarray:
                kept = at >= 0
                return np.bincount(at[kept] * size + s[own][kept], w[kept], n * size).reshape(n, size)  # noqa: B023  called at once

            lower = _order(np.bincount(s[own], w, size)[None], np.full((1, size), 1 / 256))
            one = _order(seen(a[own], size), np.broadcast_to(lower, (size, size)))
            two = _order(seen(pair_at[own], len(pair)), one[pair % size])
            three = _order(seen(deep_at[own], len(deep)), two[np.searchsorted(pair, deep % (size * size))])
            self.cost[:, :, k] = np.rint(-np.log2(np.concatenate([one, two, three])) * UNIT)
        self.cost = self.cost.reshape(-1, langs)

    @property
    def nbytes(self) -> int:
        return self.cost.nbytes + self.near.nbytes + self.far.nbytes

    def lengths(self, folded: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.symbol[folded]
        a, b, c = _contexts(x, offsets, int(self.symbol[_NEWLINE]))
        out = np.zeros((len(offsets) - 1, self.cost.shape[1]), np.int64)
        for low in range(0, len(x), CHUNK):
            high = min(low + CHUNK, len(x))
            node = self.near[b[low:high].astype(np.int32) * self.size + a[low:high]]
            node = self.far[node * self.size + c[low:high]]
            cost = self.cost.take(node.astype(np.int64) * self.size + x[low:high], axis=0)
            d0, d1 = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
            docs = np.arange(d0, d1)
            docs = docs[offsets[docs] < offsets[docs + 1]]
            begin = np.maximum(offsets[docs], low) - low
            out[docs] += np.add.reduceat(cost, begin, axis=0, dtype=np.int64)
        return out


def _kept(context: np.ndarray, owner: np.ndarray, count: np.ndarray, langs: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that some language has often enough, and the place among them of each row's context, or -1 where its language has it too seldom."""
    keys, place = np.unique(context, return_inverse=True)
    often = np.bincount(place * langs + owner, count, len(keys) * langs).reshape(len(keys), langs) >= min_count
    kept = often.any(1)
    return keys[kept], np.where(often[place, owner], (np.cumsum(kept) - 1)[place], -1)


def _groups(owner: np.ndarray, gram: np.ndarray, langs: int, most: int) -> list[tuple[int, int]]:
    """Neighbouring languages whose shared tables take at most ``most`` bytes; a larger language is alone."""
    out, first = [], 0
    contexts = symbols = np.zeros(0, np.int64)
    for k in range(langs):
        own = gram[owner == k]
        new, bytes_ = own >> 8, np.unique(np.concatenate([own >> s & 255 for s in (0, 8, 16, 24)]))
        wide, used = np.union1d(contexts, np.concatenate([new, -1 - (new & 0xFFFF)])), np.union1d(symbols, bytes_)
        if k > first and 4 * (len(wide) + len(used)) * (len(used) + 1) * (k + 1 - first) > most:
            out.append((first, k))
            first, wide, used = k, np.unique(np.concatenate([new, -1 - (new & 0xFFFF)])), bytes_
        contexts, symbols = wide, used
    return [*out, (first, langs)] if langs else []


class Model:
    """Code lengths by language, from counts of (language, gram)."""

    def __init__(self, rows: pa.Table | list[tuple[str, int, int]], min_count: int = MIN_COUNT, most: int = GROUP_BYTES):
        if not isinstance(rows, pa.Table):
            rows = pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())))})
        coded = rows["lang"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names = coded.dictionary.to_pylist()
        self.langs = sorted(names)
        rank = np.array([self.langs.index(x) for x in names], np.int64)
        owner = rank[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
        gram, count = (rows[c].to_numpy() for c in ("gram", "n"))
        self.tables = []
        for first, end in _groups(owner, gram, len(self.langs), most):
            own = (owner >= first) & (owner < end)
            self.tables.append(Tables(end - first, owner[own] - first, gram[own], count[own], min_count))

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.tables)

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units of 2**-16 bits."""
        folded = fold(raw, latin=True)
        return np.concatenate([np.zeros((len(offsets) - 1, 0), np.int64), *(t.lengths(folded, offsets) for t in self.tables)], axis=1)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` rows of each language, drawn by a hash of ``key``."""
    known = df.where(F.col(lang).isNotNull())
    share = F.lit(0.0)
    for name, n in known.groupBy(lang).count().collect():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, rows / n))).otherwise(share)
    draw = (F.xxhash64(key).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    sample = known.where(draw < share)
    return Model(gram_counts(sample, text, lang).toArrow())


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the ``extra`` columns, ``lang_pred`` and ``score`` (the posterior with equal priors)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in bounded(batches, -1):
            column = batch.column(batch.num_columns - 1)
            raw, offsets = text_bytes(column)
            letters = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
            wide = np.concatenate([[0], np.cumsum(raw >= 128)])
            plain, other = (np.diff(x[offsets]) > 0 for x in (letters, wide))
            for k in np.flatnonzero(other & ~plain):
                plain[k] = any(map(str.isalpha, column[int(k)].as_py()))
            best, score = np.full(len(plain), len(m.langs)), np.zeros(len(plain))
            if m.langs:
                bits = m.lengths(raw, offsets)
                best = np.where(plain, bits.argmin(1), len(m.langs))
                gap = (bits - bits.min(1, keepdims=True)) / UNIT
                score = np.where(plain, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = df.select(doc_id, *(c.alias(k) for k, c in extra.items()), text)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
