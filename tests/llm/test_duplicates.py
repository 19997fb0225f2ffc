"""SimHash classes and shared passages against brute force."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from words import text_of
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from wayfold.llm import graph, op01_simhash, op02_substrings


def slow_fingerprint(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b", max_size=60))
def test_fingerprint(text):
    assert op01_simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [4, 4096])
def test_classes(spark, block):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {0}
    for x in base:
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = graph.components(op01_simhash.links(df, 4, block)).collect()
    of = {r.node: r.component for r in got}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for y, s in zip(prints[:i], signed[:i], strict=True):
            if bin(x ^ y).count("1") <= 4:
                a, b = sorted((find(signed[i]), find(s)))
                root[b] = a
    assert {x: of.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_bit_sliced_comparison():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ np.uint64(7)
    run = np.zeros(300, np.int64)
    for radius in (0, 3, 4, 7):
        forest = op01_simhash.linked(fp, run, radius)
        near = {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(int(fp[i] ^ fp[j])).count("1") <= radius}
        assert set(forest.edges) <= near
        assert all(forest.root[i] == forest.root[j] for i, j in near)


def test_similar(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(2000)]
    docs = [rng.choices(words, k=400) for _ in range(30)]
    for k in range(10):  # one word in a hundred changed: a similarity of about 0.9
        docs.append([rng.choice(words) if i % 100 == 50 + k else w for i, w in enumerate(docs[k])])
    docs.append(docs[12][:200] + docs[13][:200])  # half of each: not similar enough
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op01_simhash.similar(df).collect()}
    assert got == {**{k: k for k in range(30)}, **{30 + k: k for k in range(10)}, 40: 40}
    assert op01_simhash.similar(df.where("false")).count() == 0


def test_similar_is_the_verified_jaccard_similarity(spark):
    """Pairs over 0.8 are linked and those under it are not, also with many repeats of one shingle."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    docs = []
    for k in range(150):  # c words changed at places apart: 5 c of 396 shingles differ, J = (396 - 5 c) / (396 + 5 c)
        one = rng.sample(words, 400)
        changed = rng.sample(range(4, 395, 6), 7 + k % 4)
        docs += [one, [f"x{i}" if i in changed else w for i, w in enumerate(one)]]
    for _ in range(10):  # a long run of one word is one shingle, not most of the text
        docs += [["same"] * 2000 + rng.sample(words, 60) for _ in range(2)]
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    near = [len(x & y) / len(x | y) for x, y in zip(sets[::2], sets[1::2], strict=True)]
    assert min(near[:150]) < 0.79 and max(near[:150]) < 0.86
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op01_simhash.similar(df).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(len(near))]
    assert all(got[2 * k] == 2 * k for k in range(len(near)))
    assert not any(x for x, j in zip(linked, near, strict=True) if j < 0.8)
    over = [x for x, j in zip(linked, near, strict=True) if j >= 0.8]
    assert len(over) >= 70 and sum(over) >= 0.95 * len(over)


def test_odd_rows(spark, odd_rows):
    rows = op01_simhash.classes(odd_rows).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[4].component_id == 2
    assert op01_simhash.classes(odd_rows.where("false")).count() == 0
    rows = op02_substrings.repeats(odd_rows).collect()
    assert len(rows) == 9 and all((r.class_id, r.n_links, r.spans) == (r.doc_id, 0, []) for r in rows)
    assert op02_substrings.repeats(odd_rows.where("false")).count() == 0


def test_passages(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.sample(words, 60)
    near = shared[:30] + ["changed"] + shared[31:]
    docs = [rng.sample(words, 300) for _ in range(40)]
    for k in range(8):
        docs[k][100:100] = shared
    docs[8][50:50] = near
    docs[9] = docs[10][:]
    docs[11][:0] = shared[:40]  # too short to be a passage
    docs[12] = ["same"] * 200
    docs[13] = ["x", *["same"] * 80]
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    rows = {r.doc_id: r for r in op02_substrings.repeats(df).collect()}
    assert len(rows) == 40 and {k for k, r in rows.items() if r.n_links} == {*range(11), 12, 13}
    assert all(r.n_links >= 7 for k, r in rows.items() if k < 8) and {r.class_id for k, r in rows.items() if k > 13} == {*range(14, 40)}
    assert {rows[k].class_id for k in range(9)} == {0} and {rows[9].class_id, rows[10].class_id} == {9}
    for k in range(8):
        assert any(s.start <= 100 and s.end >= 160 for s in rows[k].spans)
    assert [(s.start, s.end) for s in rows[10].spans] == [(0, 300)]


def stretches(one, two, least=46, similarity=0.8):
    """Whether some stretches of ``least`` shingles are similar enough, by trying all."""
    grams = [[tuple(d[i : i + 5]) for i in range(len(d) - 4)] for d in (one, two)]
    known = {g: k for k, g in enumerate({*grams[0], *grams[1]})}
    x, y = ([known[g] for g in d] for d in grams)
    if len({*x} & {*y}) < 41:
        return False
    for i in range(len(x) - least + 1):
        own = {*x[i : i + least]}
        for j in range(len(y) - least + 1):
            both = len(own & {*y[j : j + least]})
            if both >= similarity * (2 * least - both):
                return True
    return False


def linked_pairs(spark, docs):
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    found, _ = op02_substrings.links(df)
    return {(r.a, r.b) for r in found.select("a", "b").distinct().collect()}


def test_passages_of_the_least_length_with_a_word_changed(spark):
    """Of random pairs with a passage of fifty words and one edit, every pair that brute force finds similar, at least 0.9 of them."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    docs, want = [], set()
    for k in range(150):
        passage = rng.sample(words, 50)
        other, at = passage[:], rng.randrange(50)
        other[at : at + 1] = rng.choice([["new"], ["new", passage[at]], []])
        pair = []
        for body in (passage, other):
            d = rng.sample(words, 120)
            place = rng.randrange(121)
            d[place:place] = body
            pair.append(d)
        docs += pair
        if stretches(*pair):
            want.add((2 * k, 2 * k + 1))
    got = linked_pairs(spark, docs)
    assert len(want) >= 100 and len(got & want) >= 0.99 * len(want)
    assert all(stretches(docs[a], docs[b]) for a, b in got - want)


def test_a_line_that_all_share_does_not_hide_a_passage(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(6000)]
    docs, want = [], set()
    for g in range(12):
        line = rng.sample(words, 20 + 2 * g)
        passage = [*rng.sample(words, 30), *line, *rng.sample(words, 5)]
        for k in range(12):
            d = rng.sample(words, 100)
            d[50:50] = passage if k in (3, 8) else line
            docs.append(d)
        docs[12 * g + 8][60] = "changed"
        want.add((12 * g + 3, 12 * g + 8))
    assert linked_pairs(spark, docs) == want


def test_many_contexts_of_one_signature(spark):
    """Over ``FEW`` contexts: variants of one passage, each with its own change, are one class."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(6000)]
    line = rng.sample(words, 56)
    docs = []
    for k in range(150):
        own = line[:]
        own[28] = f"x{k}"
        docs.append([*rng.sample(words, 60), *own, *rng.sample(words, 60)])
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    assert {r.class_id for r in op02_substrings.repeats(df).collect()} == {0}


@pytest.mark.parametrize("group", [16, op02_substrings.GROUP])
def test_passages_around_a_line_of_many_surroundings(spark, monkeypatch, group):
    """Twenty words, a changed one and a line that hundreds of others have: only the line has a signature, and the pairs are found all the same."""
    monkeypatch.setattr(op02_substrings, "GROUP", group)
    rng = random.Random(17)
    words = [f"w{k}" for k in range(8000)]
    line, common = rng.sample(words, 29), rng.sample(words, 12)
    heads = {k: rng.sample(words, 20) for k in range(0, 300, 25)}
    docs = []
    for k in range(300):
        own = heads[k // 2 * 2 if k % 2 and k // 2 * 2 in heads else k] if k in heads or (k % 2 and k - 1 in heads) else rng.sample(words, 20)
        docs.append([*rng.sample(words, 40), *own, f"x{k}", *line, f"y{k}", *(common if k % 3 else []), *rng.sample(words, 40)])
    want = {(k, k + 1) for k in heads if k % 2 == 0}
    assert len(want) == 6 and linked_pairs(spark, docs) == want


def test_shuffle_files_go_once_their_rows_are_written(spark, monkeypatch):
    """Between the steps nothing stays on disk but what the steps wrote."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.sample(words, 80)
    docs = [[*rng.sample(words, 30), *(shared if k % 2 else []), *rng.sample(words, 30)] for k in range(60)]
    df = spark.createDataFrame([(k, text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        each = disk.getAllFiles().iterator()
        return {name for name in iter(lambda: each.next().getName() if each.hasNext() else None, None) if name.startswith("shuffle_")}

    before = files()
    # without the components, whose few rows are written by other code
    monkeypatch.setattr(op02_substrings, "components", lambda edges: edges.select(F.col("a").alias("node"), F.col("a").alias("component")))
    pairs, _ = op02_substrings.candidates(df, "doc_id", "text", op02_substrings.SHINGLE, 46, 0.8)
    assert pairs.schema.names[:2] == ["a", "b"]
    for _ in range(50):  # the removal runs beside the query
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_pairs_of_groups_that_cross_batches(monkeypatch, pairs):
    """Each group's rows of different documents, components and (in a split group) parts, once, whatever the batches."""
    monkeypatch.setattr(op02_substrings, "PAIRS", pairs)
    rng = np.random.default_rng(23)
    deal = np.sort(rng.integers(0, 30, 300))
    whole = (deal % 3 > 0).astype(np.int64)
    doc = rng.integers(0, 40, 300)
    rows = list(zip(deal.tolist(), np.where(whole, 0, rng.integers(0, 2, 300)).tolist(), whole.tolist(), doc.tolist(), range(300), (doc // 5).tolist(), strict=True))
    want = sorted(min((x[3:5], y[3:5]), (y[3:5], x[3:5])) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[5] != y[5] and (x[1] != y[1] or x[2]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 17], strict=True)], names=["deal", "part", "whole", "doc", "span", "comp"]) for k in range(0, 300, 17)]
    got = sorted(((a, i), (b, j)) for out in op02_substrings._compare(batches) for a, i, b, j in zip(*(c.to_pylist() for c in out.columns), strict=True))
    assert got == want


def test_passage_verification_takes_the_given_similarity():
    x = np.arange(100, dtype=np.uint32)
    assert op02_substrings.passages(x, x.copy(), 46, 0.8) == [(0, 100, 0, 100)]
    y = np.concatenate([x[:50], np.arange(1000, 1040, dtype=np.uint32), x[50:]])
    assert [p[:2] for p in op02_substrings.passages(x, y, 46, 0.8)] == [(0, 50), (50, 100)]
    assert op02_substrings.passages(x[:40], y, 46, 0.8) == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200), (102, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_large_group_lists_pairs_in_proportion(spark, monkeypatch):
    """Of n texts at a similarity of 0.80 to 0.85 to each other, a bounded number of pairs a text is verified."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def variant():
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    listed = []
    real = op01_simhash._verified
    monkeypatch.setattr(op01_simhash, "_verified", lambda pairs, *rest: listed.append(pairs.count()) or real(pairs, *rest))
    for n in (300, 1200):
        listed.clear()
        rows = [(k, variant()) for k in range(n)] + [(n + k, f"other text {k} of its own {k * k} with few words") for k in range(50)]
        got = op01_simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id")
        assert got.where(F.col("component_id") == 0).count() == n and got.select("component_id").distinct().count() == 51
        assert sum(listed) < 40 * n


def test_a_large_group_of_texts_almost_similar_lists_rows_in_proportion(spark, monkeypatch):
    """Of n texts at a similarity of 0.66 to 0.79 to each other none are linked, each with its own near copy is, and no pairs of them are written."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows, n = [], 400
    for k in range(n):
        words = list(base)
        for place in rng.sample(range(5, 295, 6), 6):
            words[place] = f"x{rng.randrange(10**9)}"
        rows += [(k, " ".join(words)), (n + k, " ".join(words[:-1]))]
    listed = []
    real = op01_simhash._verified
    monkeypatch.setattr(op01_simhash, "_verified", lambda met, *rest: listed.append(met.count()) or real(met, *rest))
    got = op01_simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id").collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % n for k in range(2 * n)}
    assert sum(listed) < 40 * 2 * n


def test_similar_links_are_those_of_brute_force():
    """Small and large runs, empty sets among them, and runs of two parts."""
    rng = np.random.default_rng(4)
    for n, block in ((150, 1), (150, 150), (40, 40)):
        sets = [np.unique(rng.choice(60, rng.integers(0, 45), replace=False).astype(np.uint32)) for _ in range(n)]
        run = np.arange(n) // block
        fp = np.zeros((4, n), np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        forest = op01_simhash.similar_links(fp, run, op01_simhash.Sets(np.concatenate(sets), bounds, 0.5), 57)
        linked = {(i, j) for i in range(n) for j in range(i + 1, n) if run[i] == run[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
        assert set(forest.edges) <= linked and all(forest.root[i] == forest.root[j] for i, j in linked)
