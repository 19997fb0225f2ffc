"""Language model: units, counts, exact probabilities against a plain walk, the base score, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import op12_lm as op
from wayfold.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = bytes([op.END])


def slow_units(text):
    """Units of a text with the byte before each."""
    raw = (text or "").translate(LOWER).encode()
    parts = re.findall(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", raw)
    tail = raw[sum(map(len, parts)) :]
    out, before = [], END
    for p in [*parts, tail + END]:
        out.append(before + p)
        before = p[-1:]
    return out


def mixed_text(odd_rows):
    return [r.text for r in odd_rows.select("text").collect() if len(r.text or "") < 1000]


def test_units(odd_rows):
    texts = [*mixed_text(odd_rows), " lead", "trail \n ", "A\x0bB\x0cc", "end"]
    u = op.Units(pa.array(texts))
    flat = [u.bytes[a:b].tobytes() for a, b in zip(u.offsets, u.offsets[1:], strict=False)]
    want = [slow_units(t) for t in texts]
    assert [[flat[k] for k in u.of[a:b]] for a, b in zip(u.first, u.first[1:], strict=False)] == want
    assert dict(zip(flat, u.count.tolist(), strict=True)) == Counter(x for w in want for x in w)
    assert len(set(flat)) == len(flat)


def model(spark, texts, **kw):
    return op.train(spark.createDataFrame([(t,) for t in texts], "text string"), **kw)


def slow_slots(tree, unit, bits):
    """(turn, byte before, slots) of each turn of a unit, one by one."""
    mask32, mask64 = (1 << 32) - 1, (1 << 64) - 1

    def folded(code, seed):
        return ((code + seed + 1) * 0x9E3779B97F4A7C15 & mask64) >> 32

    for i in range(1, len(unit)):
        contexts, code = [], 0
        for back in range(1, max(op.ORDERS) + 1):
            code = (code * 257 + (unit[i - back] + 1 if back <= i else 0)) & mask64
            if back in op.ORDERS:
                contexts.append(folded(code, back))
        base, total, power = 0xD1342543DE82EF95, 0, 1
        for b in unit[1:i]:
            total = (total + power * (b + 1)) & mask64
            power = power * base & mask64
        contexts.append(folded(total, 0))
        for k in range(tree.offset[unit[i]], tree.offset[unit[i] + 1]):
            slots = []
            for c in contexts:
                s = c ^ int(tree.node[k])
                s = s * 0x2C1B3C6D & mask32
                s ^= s >> 15
                s = s * 0x297A2D39 & mask32
                slots.append(s >> (32 - bits))
            yield int(tree.turn[k]), unit[i - 1], slots


@pytest.fixture(scope="module")
def small(spark):
    texts = [f"The {a} {b} sat on the {c}.\n" * (1 + k % 3) for k, (a, b, c) in enumerate((x, y, z) for x in ("old", "new", "red") for y in ("cat", "dog", "owl") for z in ("mat", "roof", "Straße"))]
    return texts, model(spark, texts)


def test_tables_hold_the_counts(small):
    texts, scorer = small
    m = scorer.model
    want = [Counter() for _ in range(op.PREDICTORS)]
    for unit, n in Counter(u for t in texts for u in slow_units(t)).items():
        for turn, _, slots in slow_slots(m.tree, unit, m.bits):
            for k, s in enumerate(slots):
                want[k][s, turn] += n
    for k, table in enumerate(m.tables):
        pairs = {int(s): (int(op.LEVEL[table[s] >> 8]), int(op.LEVEL[table[s] & 255])) for s in np.flatnonzero(table)}
        level = lambda n: int(op.LEVEL[np.searchsorted(op.LEVEL, n, "right") - 1])
        assert pairs == {s: (level(want[k][s, 0]), level(want[k][s, 1])) for s in {s for s, _ in want[k]}}


def slow_score(m, text):
    total = 0.0
    for unit in slow_units(text):
        for turn, before, slots in slow_slots(m.tree, unit, m.bits):
            grades = [int(op._BYTE[t[s]]) for t, s in zip(m.tables, slots, strict=True)]
            a, b, c = (min(g // op.GRADES, 2) for g in grades[-3:])
            w = m.weights[(a * 3 + b) * 3 + c]
            odds = w[-1] + sum(x * ((g % op.GRADES) - 42) / 5 for x, g in zip(w, grades, strict=False))
            cell = int(min(max(odds * op.SPREAD + op.BUCKETS // 2 + 0.5, 0), op.BUCKETS - 1))
            p = m.map[before, cell]
            total += math.log10(p if turn else 1 - p)
    return total


def test_scores_equal_a_plain_walk(spark, small, odd_rows):
    _, scorer = small
    docs = odd_rows.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    got = op.score(docs.withColumns({"row": F.lit(1), "score": F.lit("x"), "rare": F.lit(2)}), scorer, extra={"lang": F.col("lang")}).collect()
    want = sorted((r.doc_id or 0, slow_score(scorer.model, r.text)) for r in docs.collect())
    assert len(got) == docs.count()
    for r, (i, s) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.score)), want, strict=True):
        assert (r.doc_id or 0) == i and abs(r.score - s) < 0.02 * max(1, abs(s)) ** 0.5 and r.score < 0


def test_probabilities_add_up_to_one(small):
    """All bytes that may follow share one: any prefix, by the tree's turns."""
    m = small[1].model
    reader = op.Reader(m)
    for prefix in (END, END + b" ", b"d c", b"e strang"):
        units = [prefix + bytes([s]) for s in range(256)]
        flat = np.frombuffer(b"".join(units), np.uint8)
        offsets = np.arange(257) * (len(prefix) + 1)
        base = 0.0 if len(prefix) == 1 else reader.unit_scores(np.frombuffer(prefix, np.uint8), np.array([0, len(prefix)]))[0]
        assert abs(np.exp(reader.unit_scores(flat, offsets) - base).sum() - 1) < 1e-6


def slow_base(train, texts):
    count = Counter()
    for t in train:
        count.update([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    for t in texts:
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
        yield len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)


@pytest.mark.parametrize("frequent", [3, 1 << 20])
def test_base_scores(spark, odd_rows, frequent, monkeypatch):
    """With few words sent to the tasks, and with all."""
    monkeypatch.setattr(op, "FREQUENT", frequent)
    rows = odd_rows.select("doc_id", "text").collect()
    scorer = op.train(odd_rows)
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in op.score(odd_rows, scorer).collect())
    assert got == sorted((a, b, c, round(d, 6)) for a, b, c, d in slow_base([r.text for r in rows], [r.text for r in rows]))
    assert all(r.bits_per_byte >= 0 for r in op.score(odd_rows, scorer).collect())


def test_empty(spark, odd_rows):
    none = odd_rows.limit(0)
    scorer = op.train(none)
    got = op.score(odd_rows, scorer).collect()
    assert len(got) == odd_rows.count() and {r.base_score for r in got} == {0.0} and {r.n_known for r in got} == {0}
    assert op.score(none, scorer).count() == 0 and op.score(none, op.train(odd_rows)).count() == 0
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("rows_")]
    assert op.train(odd_rows) and [t.name for t in spark.catalog.listTables() if t.name.startswith("rows_")] == left  # nothing stays behind


def test_the_query(spark, sf_dir):
    rows = queries.op12_lm_score(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {r.doc_id: r.held_out for r in rows}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    want = dict(zip(docs, slow_base([t for i, t in docs.items() if not held[i]], docs.values()), strict=True))
    for r in rows:
        a, b, c, d = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, c) and abs(r.base_score - d) < 1e-6 * max(1, abs(d))
    out = [r for r in rows if r.held_out and r.n_tokens > 50]
    assert sum(r.bits_per_byte for r in out) / len(out) < 3  # texts not learned from; bytes alone have an entropy of 4.6


def test_weights_and_map_see_every_unit(spark, monkeypatch):
    """Fitting takes the whole table of units, whatever its size."""
    seen, texts = [], [" ".join(f"w{k * k}" for k in range(n)) for n in range(60)]
    monkeypatch.setattr(op, "FIT_UNITS", 4, raising=False)
    for name in ("_learn_weights", "_learn_map"):
        real = getattr(op, name)
        monkeypatch.setattr(op, name, lambda units, m, real=real: seen.append({bytes(r.unit) for r in units.select("unit").collect()}) or real(units, m))
    model(spark, texts)
    want = {u for t in texts for u in slow_units(t)}
    assert seen == [want, want]


def test_frequent_units_are_scored_once(spark):
    """Units that training saw often come with their scores; a batch computes the others only, and gets the same scores."""
    texts = ["so it goes and so it went \n", "\t and  it goes on", "", None, "Ärger und 日本語 so"]
    scorer = model(spark, texts)
    reader = op.Reader(scorer.model)
    code, score = scorer.units
    seen = op.Units(pa.array(texts))
    assert (np.diff(code.view(np.int64).astype(object)) != 0).all() and set(code.tolist()) == set(seen.code.tolist())
    np.testing.assert_allclose(score[np.searchsorted(code, seen.code)], reader.unit_scores(seen.bytes, seen.offsets), rtol=1e-12)
    new = op.Units(pa.array(["so it goes elsewhere", "and so\x0bon"]))
    asked = []

    class Counting:
        def unit_scores(self, flat, offsets):
            asked.append(len(offsets) - 1)
            return reader.unit_scores(flat, offsets)

    np.testing.assert_allclose(op.unit_scores(new, Counting(), scorer.units), reader.unit_scores(new.bytes, new.offsets), rtol=1e-12)
    assert asked == [int((~np.isin(new.code, code)).sum())] and 0 < asked[0] < len(new.code)
