"""Ranked search: every rank against a plain scorer, ties, odd rows, blocks of queries."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.llm import op13_search as op
from wayfold.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k=50):
    """(item place, rank, id, score) by the stated formula."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for place, (item, text) in enumerate(items):
        want = set(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in want}
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in want if b[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_ranks(spark, odd_rows):
    docs = odd_rows.select("doc_id", "text").collect()
    texts = ["lazy DOG brücke", "twice", "", None, "日本語 12", "no such words here", " ".join(r.text or "" for r in docs if len(r.text or "") < 1000), "twice"]
    items = spark.createDataFrame(list(enumerate(texts[:-1])) + [(1, texts[-1])], "item_id long, text string").withColumn("rank", F.lit("x"))
    for k in (1, 3, 50):
        assert got(op.search(odd_rows, items, k)) == slow([tuple(r) for r in docs], [(1 if i == 7 else i, t) for i, t in enumerate(texts)], k)


def test_ties_and_many_documents(spark):
    """Equal texts in many places, a hot term, and a threshold that ties at the last rank."""
    docs = [(k, f"common w{k % 7} {'x ' * (k % 3)}") for k in range(700)] + [(-5, "common w1 x"), (None, "common w1 x")]
    items = [(k, f"common w{k}") for k in range(7)] + [(7, "x x x"), (8, "common")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(op.search(d, spark.createDataFrame(items, "item_id long, text string"), 20)) == slow(docs, items, 20)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(op, "ITEMS", 3)
    docs = [(k, f"a{k % 5} b{k % 11} c") for k in range(60)]
    items = [(k, f"a{k % 5} b{k}") for k in range(8)]
    assert got(op.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == slow(docs, items)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty(spark, empty):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    d = some.limit(0) if empty != "items" else some
    i = items.limit(0) if empty != "docs" else items
    assert op.search(d, i).count() == 0


def test_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert got(queries.op13_search(spark, sf_dir)) == slow([tuple(r) for r in docs], [tuple(r) for r in items])
