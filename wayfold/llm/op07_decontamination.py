"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of folded words; distances count word edits, and an item
leaks where a stretch of the document is within ``RATE`` of the item's length.

* A CGK walk reads a window word by word; a random bit of (step, word) tells
  whether it moves on, so two windows at a small edit distance soon walk in
  step again and differ in few of the ``STRETCH`` * length output places.
* Each of ``REPEATS`` walks samples ``SAMPLES`` of its places as an LSH key.
  Windows have the length of the item they may hold, and start at every word
  from which they cover a run of words that is also in the item. With at most
  e edits, some run of ceil((n - e) / (e + 1)) of the n words is intact, and
  that is the run asked for of items of n words, so the start rule loses nothing.
* A window whose key equals an item's is verified: the edit distance between
  the item and the best stretch around the window, computed in full.

The benchmark is a stated set of queries. It goes to the tasks in blocks of at
most ``ITEM_WORDS`` words; each block is one pass over the documents.

Defined cases: null or empty texts and items have no words and never match;
repeated items or documents each give their own result; ties take the smaller
distance, then the earlier place; very long texts are searched whole, in windows;
a column that has the name of the output is replaced by it, all others stay; an
empty table or benchmark gives rows without leaks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import Words, bounded, mix, shingle_codes

RATE = 0.15
REPEATS = 10
SAMPLES = 3
STRETCH = 3
ITEM_WORDS = 2_000_000
BITMAP = 22
PAD = np.uint64(0)
LEAK = "array<struct<item_id:{},start_word:long,n_words:long,distance:long>>"


def edits(n: int, rate: float = RATE) -> int:
    return math.floor(n * rate)


def intact(n: int, rate: float = RATE) -> int:
    """Words of the longest run that is left whole in any item of ``n`` words, at least."""
    e = edits(n, rate)
    return max(1, math.ceil((n - e) / (e + 1)))


def nearest(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``part``, and that stretch: (distance, start, end)."""
    n = len(part)
    place = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), place.copy()
    for i, word in enumerate(item, 1):
        change = np.append(i, cost[:-1] + (part != word))
        drop = cost + 1
        best = np.minimum(change, drop)
        origin = np.where(change <= drop, np.append(0, start[:-1]), start)
        # adding words of the part: the running minimum of cost less place
        lead = np.minimum.accumulate((best - place) * (n + 2) + place)
        source = lead % (n + 2)
        cost, start = (lead - source) // (n + 2) + place, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """Benchmark items with their runs and LSH keys."""

    def __init__(self, ids: list, texts: list[str | None], rate: float = RATE, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 7):
        words = Words(pa.array(texts, pa.string()), latin=True)
        code = [words.code[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        kept = [k for k, c in enumerate(code) if len(c)]
        self.ids, self.code, self.rate = [ids[k] for k in kept], [code[k] for k in kept], rate
        rng = np.random.default_rng(seed)
        self.lengths = sorted({len(c) for c in self.code})
        longest = max(self.lengths, default=1) * STRETCH
        self.step = rng.integers(1 << 62, size=(repeats, longest), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.sampled = {n: [np.sort(rng.choice(n * STRETCH, min(samples, n * STRETCH), replace=False)) for _ in range(repeats)] for n in self.lengths}
        # by the run that items must share with a window: its hashes, the items' lengths, and a bitmap of the hashes' first bits
        self.runs = {}
        for run in sorted({intact(n, rate) for n in self.lengths}):
            codes = [c for c in self.code if intact(len(c), rate) == run]
            grams = [shingle_codes(c, run) for c in codes]
            pairs = np.unique(np.stack([np.concatenate(grams).view(np.int64), np.repeat([len(c) for c in codes], [len(g) for g in grams])]), axis=1)
            code, order = pairs[0].view(np.uint64), np.argsort(pairs[0].view(np.uint64), kind="stable")
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[code >> np.uint64(64 - BITMAP)] = True
            self.runs[run] = code[order], pairs[1][order], bitmap
        self.keys = {}
        for n in self.lengths:
            own = [k for k, c in enumerate(self.code) if len(c) == n]
            flat = np.concatenate([self.code[k] for k in own])
            start = np.arange(len(own)) * n
            for r in range(repeats):
                key = self.embed(flat, start, start + n, n, r)
                order = np.argsort(key, kind="stable")
                self.keys[n, r] = key[order], np.array(own)[order]

    def embed(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, r: int) -> np.ndarray:
        """The sampled places of walk ``r`` over windows from ``start`` to ``end``, hashed to one key each."""
        sampled = self.sampled[n][r]
        at, key, taken = start.copy(), np.full(len(start), r + 1, np.uint64), set(sampled.tolist())
        for j in range(int(sampled[-1]) + 1):
            word = np.where(at < end, code[np.minimum(at, len(code) - 1)], PAD)
            if j in taken:
                key = mix(key ^ word)
            at += (word * self.step[r, j] >> np.uint64(63)).astype(np.int64)
        return key

    def candidates(self, code: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, window start) of windows whose key is an item's."""
        found: set[tuple[int, int, int]] = set()
        for run, (known, lengths, bitmap) in self.runs.items():
            own = shingle_codes(code, run)
            hits = np.flatnonzero(bitmap[own >> np.uint64(64 - BITMAP)])
            low, high = np.searchsorted(known, own[hits]), np.searchsorted(known, own[hits], "right")
            hits, low, high = hits[low < high], low[low < high], high[low < high]
            if not len(hits):
                continue
            place = np.repeat(hits, high - low)
            entry = np.arange(len(place)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            length = lengths[entry]
            doc_of = np.searchsorted(first, place, "right") - 1
            for n in np.unique(length).tolist():
                near, doc = place[length == n], doc_of[length == n]
                slack = edits(n, self.rate)
                start = (near[:, None] + np.arange(run - n - slack, 1)[None]).ravel()
                doc = np.repeat(doc, n + slack + 1 - run)
                inside = start >= first[doc]
                start, once = np.unique(start[inside], return_index=True)
                doc = doc[inside][once]
                end = np.minimum(start + n, first[doc + 1])
                for r in range(len(self.step)):
                    keys, owner = self.keys[n, r]
                    key = self.embed(code, start, end, n, r)
                    low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    for w in np.flatnonzero(low < high):
                        found.update((int(doc[w]), int(k), int(start[w])) for k in owner[low[w] : high[w]])
        return found

    def leaks(self, code: np.ndarray, first: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """By document and item the best verified stretch: (distance, start, words)."""
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        spans: dict[tuple[int, int], list[int]] = {}
        for doc, item, start in self.candidates(code, first):
            spans.setdefault((doc, item), []).append(start)
        for (doc, item), starts in sorted(spans.items()):
            n = len(self.code[item])
            slack = edits(n, self.rate)
            starts.sort()
            at = 0
            while at < len(starts):
                last = at
                while last + 1 < len(starts) and starts[last + 1] <= starts[last] + n:
                    last += 1
                low, high = max(starts[at] - slack, first[doc]), min(starts[last] + n + slack, first[doc + 1])
                distance, a, b = nearest(self.code[item], code[low:high])
                if distance <= slack:
                    best = (distance, int(low + a - first[doc]), b - a)
                    own = out.setdefault(doc, {})
                    own[item] = min(best, own.get(item, best))
                at = last + 1
        return out


def scan(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", rate: float = RATE) -> DataFrame:
    """Append the array ``out`` of (item_id, start_word, n_words, distance) to every row; empty without leaks."""
    kind = items.schema[item_id].dataType
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / ITEM_WORDS))  # a word and its space have two characters at least
    block = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks))
    df = df.drop(*(c for c in df.columns if c.lower() == out.lower()))
    for b in range(blocks):
        rows = items.where(block == b).select(item_id, item_text).orderBy(item_id, item_text).collect()
        df = _pass(df, Items([r[0] for r in rows], [r[1] for r in rows], rate), kind, text, out)
    return df


def _pass(df: DataFrame, items: Items, kind: T.DataType, text: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    at = df.columns.index(text)
    before = df.columns.index(out) if out in df.columns else None
    schema = df.schema if before is not None else T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(LEAK.format(kind.simpleString())))])

    def run(batches):
        held = shared.value
        for batch in bounded(batches, at):
            words = Words(batch.column(at), latin=True)
            found = held.leaks(words.code, words.first) if held.ids and len(words.code) else {}
            lists = [[{"item_id": held.ids[k], "start_word": s, "n_words": n, "distance": d} for k, (d, s, n) in sorted(found.get(row, {}).items())] for row in range(batch.num_rows)]
            if before is not None:
                lists = [a + b for a, b in zip(batch.column(before).to_pylist(), lists, strict=True)]
            from pyspark.sql.pandas.types import to_arrow_type

            column = pa.array(lists, to_arrow_type(schema[out].dataType))
            columns = [c for k, c in enumerate(batch.columns) if k != before]
            names = [c for c in batch.schema.names if c != out]
            if before is None:
                yield pa.RecordBatch.from_arrays([*columns, column], names=[*names, out])
            else:
                yield pa.RecordBatch.from_arrays([*columns[:before], column, *columns[before:]], names=batch.schema.names)

    return df.mapInArrow(run, schema)
