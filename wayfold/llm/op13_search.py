"""Ranked lexical search by hashed max-sketches and exact rescoring.

Every document is folded into a sketch: its terms hash to ``WIDTH``
coordinates, and a coordinate holds the largest saturated frequency of the terms that
fall there. A query looks its terms up in the sketch, weighs them and adds:
that is never less than the score, since a term's own coordinate is never
less than the term. All queries of a block look up at once, as one product of
the sketches with the weights by coordinate. Each query then visits documents
by falling bound, scores them exactly, and stops where the bound is below the
score at its last rank. Tasks keep ``k`` documents a query; their lists are
merged in two levels.

Score of a document: sum over the query's distinct terms of
``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 50 + (50 * n * N) div L``, all else in whole numbers.

Defined cases: null and empty texts have no terms, so they are in no result
and not in N; items without terms have no rows; repeated items are ranked each for
itself, repeated documents stand one after the other; equal scores go by
ascending id, null ids last; very long texts are sketched whole (a batch of
their own); empty tables give no rows; other columns are not read, so their
names do not matter. Terms are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.common import Words, bounded, materialize

TOP = 50
#: Coordinates of a sketch.
WIDTH = 2048
#: A block of queries holds at most so many items and characters; longer query sets take more blocks.
ITEMS, CHARACTERS = 512, 4 << 20
#: Documents that a query scores before it looks at its threshold again.
STEP = 64
#: Groups of tasks whose lists are merged first.
GROUPS = 1024


class Queries:
    """A block of queries: distinct terms, and each query's terms as places in them."""

    def __init__(self, texts: list[str | None]):
        words = Words(pa.array(texts, pa.string()))
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        pairs = np.unique(np.stack([owner.astype(np.uint64), words.code]), axis=1) if len(owner) else np.zeros((2, 0), np.uint64)
        self.terms = np.unique(pairs[1])
        self.owner = pairs[0].astype(np.int64)
        self.term = np.searchsorted(self.terms, pairs[1])
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.count = len(texts)

    def weigh(self, documents: int, held: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(int(t.view(np.int64)), 0) + 1))) for t in self.terms], np.int64)

    def matrix(self) -> np.ndarray:
        """Weights by coordinate and query, raised by more than the product can lose in rounding."""
        out = np.zeros((WIDTH, self.count), np.float64)
        np.add.at(out, (_coordinate(self.terms)[self.term], self.owner), self.weight[self.term].astype(np.float64))
        return (out * (1 + 2.0**-22 * (np.diff(self.first) + 16))).astype(np.float32)


def _coordinate(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(40)).astype(np.int64) % WIDTH


def _postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of each distinct term of each document, and the documents' numbers of terms."""
    words = Words(column)
    n = np.diff(words.first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.code, owner))
    code = words.code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code))), n


def _count(terms: np.ndarray):
    """A task's documents with terms (0), their terms (1) and, by query term, the documents that hold it (2)."""

    def run(batches):
        documents = total = 0
        held = np.zeros(len(terms), np.int64)
        for batch in bounded(batches, 0):
            words = Words(batch.column(0))
            n = np.diff(words.first)
            documents += int((n > 0).sum())
            total += int(n.sum())
            place = np.searchsorted(terms, words.code)
            found = np.flatnonzero(terms[np.minimum(place, len(terms) - 1)] == words.code) if len(terms) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(n)), n)[found]
            held += np.bincount(np.unique(owner * len(terms) + place[found]) % max(1, len(terms)), minlength=len(terms))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1, *[2] * len(some)], pa.int32()), pa.array([0, 0, *terms[some].view(np.int64).tolist()], pa.int64()), pa.array([documents, total, *held[some].tolist()], pa.int64())],
            ["what", "term", "amount"],
        )

    return run


class Lists:
    """The best ``k`` documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.threshold = k, np.zeros(queries, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # query, score, whether the id is null, id

    def add(self, *rows: np.ndarray) -> None:
        query, score, none, id_ = (np.concatenate(x) for x in zip(self.rows, rows, strict=True))
        order = np.lexsort((id_, none, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.rows = [query, score[order], none[order], id_[order]]
        last = rank == self.k - 1
        self.threshold[query[last]] = self.rows[1][last]


def _search(block: Queries, documents: int, terms: int, k: int):
    """A task's best ``k`` documents of each query."""

    def run(batches):
        weights, lists = block.matrix(), Lists(block.count, k)
        for batch in bounded(batches, 1):
            doc, code, tf, n = _postings(batch.column(1))
            if not len(doc):
                continue
            m = np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
            value = (10**9 * tf) // (1000 * tf + 20 * m[doc])
            sketch = np.zeros((len(n), WIDTH), np.float32)
            rising = np.argsort(value, kind="stable")  # of several values for a coordinate the last stays
            sketch[doc[rising], _coordinate(code)[rising]] = value[rising]
            bound = sketch @ weights
            # the frequencies of query terms, by document and term
            place = np.searchsorted(block.terms, code)
            known = block.terms[np.minimum(place, len(block.terms) - 1)] == code
            key, value = doc[known] * len(block.terms) + place[known], value[known]
            ids = batch.column(0)
            none = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            asked = np.flatnonzero((bound >= np.maximum(lists.threshold, 1)).any(axis=0))
            falling = np.argsort(-bound[:, asked], axis=0, kind="stable")
            for low in range(0, len(n), STEP):
                d = falling[low : low + STEP]
                live = bound[d, asked] >= np.maximum(lists.threshold[asked], 1)
                if not live.any():
                    break
                d, q = d[live], np.broadcast_to(asked, live.shape)[live]
                score = _exact(block, key, value, d, q)
                good = score > 0
                lists.add(q[good], score[good], none[d[good]].astype(np.int64), ids[d[good]])
        q, score, none, ids = lists.rows
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def _exact(block: Queries, key: np.ndarray, value: np.ndarray, d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact scores of (document, query) pairs."""
    n = block.first[q + 1] - block.first[q]  # each asked query has terms
    first = np.cumsum(n) - n
    term = block.term[np.arange(n.sum()) + np.repeat(block.first[q] - first, n)]
    want = np.repeat(d, n) * len(block.terms) + term
    at = np.minimum(np.searchsorted(key, want), len(key) - 1) if len(key) else np.zeros(len(want), np.int64)
    each = np.where(key[at] == want, value[at] * block.weight[term], 0) if len(key) else np.zeros(len(want), np.int64)
    return np.add.reduceat(each, first)


def _blocks(items: DataFrame):
    """Items in blocks of bounded size, brought to the driver one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(row[1] or "") > CHARACTERS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item id, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = items.select(F.col(item).alias("item_id")).schema["item_id"].dataType.simpleString()
    found = None
    for ids, texts in _blocks(items.select(item, query)):
        block = Queries(texts)
        counts = docs.select("text").mapInArrow(_count(block.terms), "what int, term long, amount long")
        said = {(r.what, r.term): r.amount for r in counts.groupBy("what", "term").agg(F.sum("amount").alias("amount")).collect()}
        documents, terms = said.get((0, 0), 0), said.get((1, 0), 0)
        if not documents or not len(block.terms):
            continue
        block.weigh(documents, {t: a for (what, t), a in said.items() if what == 2})
        rows = docs.mapInArrow(_search(block, documents, terms, k), "query int, doc_id long, score long").withColumn("part", F.spark_partition_id() % GROUPS)
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for by in (("query", "part"), ("query",)):
            rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {kind}")
        part = materialize(rows.join(F.broadcast(names), "query").select(F.col("item_id").alias(item), "rank", "doc_id", "score"))  # at most ITEMS names
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")
