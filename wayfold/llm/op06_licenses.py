"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, over line breaks, as long as the
template may get at the containment threshold: its words divided by
``THRESHOLD``. Every such run of a document is a block. A template matches a
block that holds at least ``THRESHOLD`` of the template's distinct words. All of
the templates' words are ordered by their count in the whole corpus, rarest
first. Let a template have n distinct words and need o = ceil(threshold * n) of
them. A matching block's rarest template word is among the template's first
n - o + 1 (prefix filter), so only places of those are candidates. A candidate in
a document of fewer than o words goes (length filter). If the template word at a
candidate has place p in the order, its block's other template words come after
p, and all of them stand within a block's length of it and in its document: with
fewer than o such words there the candidate goes (positional filter). Around what is
left, the distinct words of all blocks are counted at once, so no match is missed
and none is made up.

Templates are a parameter of fixed size, so they travel to the tasks; the
corpus is read twice, once for the counts and once for the join, and nothing
is shuffled but one count a template word and task.

Phrases are found exactly: their words stand consecutively in a document.

Defined cases: a null or empty text has no words, no labels and score 0; a very
long text is one list of words, so its length only adds blocks; blocks that
overlap and match the same template are one match, told by its fullest block,
the first of equals; null keys and repeated rows give their own result row; equal
labels count once; other columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import Words, bounded
from wayfold.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def _codes(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()))
    return [words.code[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def corpus_counts(df: DataFrame, text: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each of the given word codes occurs in all texts."""
    known = np.sort(vocabulary)

    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in bounded(batches, 0):
            code = Words(batch.column(0)).code
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            total += np.bincount(at[known[at] == code], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["code", "n"])

    rows = df.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r[0]).view(np.uint64)): r[1] for r in rows}


class Templates:
    """Templates as word sets in global order, with their need and block length."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int], threshold: float):
        codes = _codes(list(templates.values()))
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
        self.names = list(templates)
        self.size, self.need, self.span, self.rank = [], [], [], []
        for code in codes:
            own = sorted({int(c) for c in code}, key=lambda c: (counts.get(c, 0), c))
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            place = np.searchsorted(self.words, np.array(own, np.uint64))
            rank = np.full(len(self.words) + 1, -1)  # by word: its place in the template's order
            rank[place] = np.arange(len(own))
            self.size.append(len(own))
            self.need.append(need)
            self.span.append(math.ceil(len(code) / threshold - 1e-9))
            self.rank.append(rank)

    def candidates(self, k: int, place: np.ndarray, rank: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are candidates by the prefix filter, which of them the length filter leaves, and which the positional filter."""
        need = self.need[k]
        prefix = np.flatnonzero((rank >= 0) & (rank <= self.size[k] - need))
        long = prefix[np.diff(first)[owner[prefix]] >= need]
        left = long[self._around(k, place[long], owner[long], place[rank >= 0], first) >= need]
        parts = []
        for p in np.unique(rank[left]):
            at = left[rank[left] == p]
            parts.append(at[self._around(k, place[at], owner[at], place[rank >= p], first) >= need])
        return prefix, long, np.sort(np.concatenate([left[:0], *parts]))

    def _around(self, k: int, at: np.ndarray, owner: np.ndarray, held: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many of the places ``held`` are in any block of the same document that reaches over each place of ``at``."""
        low = np.maximum(at - self.span[k] + 1, first[owner])
        high = np.minimum(at + self.span[k], first[owner + 1])
        return np.searchsorted(held, high) - np.searchsorted(held, low)

    def matches(self, code: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(document, template, first word of the block, containment) of a batch of documents."""
        if not len(code) or not len(self.words):
            return []
        at = np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)
        word = np.where(self.words[at] == code, at, len(self.words))
        known = np.flatnonzero(word < len(self.words))
        word, owner = word[known], np.searchsorted(first, known, "right") - 1
        found = []
        for k in range(len(self.names)):
            if not self.size[k]:
                continue
            rank = self.rank[k][word]
            leads = self.candidates(k, known, rank, owner, first)[2]
            if not len(leads):
                continue
            own = np.flatnonzero(rank >= 0)
            own = own[self._around(k, known[own], owner[own], known[leads], first) > 0]
            found += self._blocks(k, known[own], word[own], owner[own], first)
        return found

    def _blocks(self, k: int, place: np.ndarray, word: np.ndarray, doc: np.ndarray, first: np.ndarray):
        """Blocks by the distinct words they hold: a word counts for blocks that begin after its place before and up to it."""
        span, need = self.span[k], self.need[k]
        order = np.lexsort((place, word, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (word[order][1:] == word[order][:-1])
        before = np.empty(len(place), np.int64)
        before[order] = np.concatenate([[-1], np.where(same, place[order][:-1], -1)])
        # a word at ``place`` is in the blocks that begin at low to place
        low = np.maximum(np.maximum(before + 1, place - span + 1), first[doc])
        turn = np.concatenate([low, place + 1])
        step = np.concatenate([np.ones(len(low), np.int64), np.full(len(low), -1)])
        owner = np.concatenate([doc, doc])
        order = np.lexsort((step, turn, owner))
        turn, count, owner = turn[order], np.cumsum(step[order]), owner[order]
        last = np.append((turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1]), True)
        turn, count, owner = turn[last], count[last], owner[last]
        good = np.flatnonzero(count >= need)
        out: list[tuple[int, int, int, float]] = []
        for d, s, n in zip(owner[good].tolist(), turn[good].tolist(), count[good].tolist(), strict=True):
            share = n / self.size[k]
            if out and out[-1][0] == d and s < reach:
                if share > out[-1][3]:
                    out[-1] = (d, k, s, share)
            else:
                out.append((d, k, s, share))
            reach = s + span
        return [(d, t, s - int(first[d]), c) for d, t, s, c in out]


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: phrase places, labels, and the blocks that templates match."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *_codes(list(templates.values()))]))
    known = Templates(templates, corpus_counts(df, text, vocabulary) if len(vocabulary) else {}, threshold)
    wanted = list(zip(_codes(list(phrases)), phrases.values(), strict=True))

    def run(batches):
        for batch in bounded(batches, 1):
            words = Words(batch.column(1))
            code, first = words.code, words.first
            n = len(first) - 1
            owner = np.repeat(np.arange(n), np.diff(first))
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for phrase, label in wanted:
                at = np.flatnonzero(code[: max(0, len(code) - len(phrase) + 1)] == phrase[0])
                for j in range(1, len(phrase)):
                    at = at[code[at + j] == phrase[j]]
                at = at[at + len(phrase) <= first[owner[at] + 1]]
                for i in at:
                    base[owner[i]].append((int(i - first[owner[i]]), label))
            matches: list[list[tuple[str, int, float]]] = [[] for _ in range(n)]
            for d, k, start, share in known.matches(code, first):
                matches[d].append((known.names[k], start, share))
            rows = []
            for d in range(n):
                own, blocks = sorted(base[d]), sorted(matches[d], key=lambda m: (m[1], m[0]))
                plain = sorted({label for _, label in own})
                rows.append((int(first[d + 1] - first[d]), len(own), own[0][0] if own else None, own[-1][0] if own else None, ",".join(plain), ",".join(sorted({*plain, *(m[0] for m in blocks)})), 1.0 if own else max([0.0, *(m[2] for m in blocks)]), [{"template": m[0], "word": m[1], "containment": m[2]} for m in blocks]))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("template", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[doc_id, *NAMES])

    hit = T.StructType([T.StructField("template", T.StringType()), T.StructField("word", T.LongType()), T.StructField("containment", T.DoubleType())])
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(hit)]
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in zip(NAMES, kinds, strict=True))])
    return df.select(doc_id, text).mapInArrow(run, schema)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
