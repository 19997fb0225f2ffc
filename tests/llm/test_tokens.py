"""BPE round trips and attribution of tokens to sections."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import op05_bpe, op10_attribution


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_pieces_encode_as_the_whole(text):
    whole = op05_bpe.encoding().encode_ordinary(text)
    parts = [i for p in op05_bpe.pieces(text, 5) for i in op05_bpe.encoding().encode_ordinary(p)]
    assert parts == whole and "".join(op05_bpe.pieces(text, 5)) == text
    assert op05_bpe.encoding().decode_bytes(whole) == text.encode()


def test_special_strings_are_text():
    assert len(op05_bpe.encode_text("<|endoftext|>")) > 1


def test_odd_rows(spark, odd_rows):
    rows = {r.doc_id: r for r in op05_bpe.digests(odd_rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[2].n_tokens, rows[2].ids_sha256, rows[2].decoded_sha256) == (0, empty, empty)
    texts = {r.doc_id: r.text for r in odd_rows.collect()}
    for k, r in rows.items():
        ids = op05_bpe.encoding().encode_ordinary(texts[k] or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest()
    back = op05_bpe.decode(op05_bpe.encode(odd_rows)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back) and len(back) == 10


def test_columns_named_as_the_new_ones_give_way(spark, odd_rows):
    taken = odd_rows.selectExpr("0 as TOKEN_IDS", "*", "'x' as decoded")
    once = op05_bpe.encode(taken)
    twice = op05_bpe.decode(op05_bpe.encode(once))
    assert once.columns == [*odd_rows.columns, "decoded", "token_ids"] and twice.columns == [*odd_rows.columns, "token_ids", "decoded"]
    rows = twice.collect()
    assert len(rows) == 10 and all(bytes(r.decoded).decode() == (r.text or "") for r in rows)
    # the text itself may be written over
    assert op05_bpe.encode(odd_rows, out="text").columns == [c for c in odd_rows.columns if c != "text"] + ["text"]
    assert op05_bpe.encode(odd_rows.where("false")).count() == 0


def slow_allocate(text, sections, rule):
    ids = op05_bpe.encode_text(text)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, outside, crossing, at = [0] * len(sections), 0, 0, 0
    for t in ids:
        n = len(op05_bpe.encoding().decode_single_token_bytes(t))
        chars = range(owner[at], owner[at + n - 1] + 1)
        at += n
        home = [next((k for k, (a, b) in enumerate(sections) if a <= c < b), None) for c in chars]
        crossing += len(set(home)) > 1
        pick = home[0]
        if rule == "most" and len(set(home)) > 1:
            real = [h for h in home if h is not None]
            pick = max(sorted(set(real)), key=real.count) if real else None
        if pick is None:
            outside += 1
        else:
            counts[pick] += 1
    return counts, outside, crossing


def test_allocation():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab é\n🙂 the") for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.8 and b > a]
        low, high = (np.array([s[k] for s in sections], np.int64) for k in (0, 1))
        for rule in op10_attribution.RULES:
            if not sections:
                continue
            counts, outside, crossing = op10_attribution.allocate(*op10_attribution.token_spans(text), low, high, rule)
            assert (counts.tolist(), outside) == slow_allocate(text, sections, rule)[:2], (text, sections, rule)


def test_lines(spark, odd_rows):
    rows = {r.doc_id: r for r in op10_attribution.attribute(odd_rows).collect()}
    assert (rows[2].n_tokens, rows[2].n_sections, rows[2].section_tokens) == (0, 0, [])
    for r in rows.values():
        assert sum(r.section_tokens) + r.n_outside == r.n_tokens
    df = spark.createDataFrame([(1, "one two\nthree", [(0, 3), (8, 13)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    r = op10_attribution.attribute(df, sections="parts").first()
    assert r.n_tokens == sum(r.section_tokens) + r.n_outside and r.section_tokens == [1, 1]
