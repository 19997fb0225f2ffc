"""The corpus pipeline: stages keep what they should, on the given and on odd rows."""

import hashlib
import re

import corpus_pipeline as p
import numpy as np
from pyspark.sql import functions as F
from test_scans import slow_statistics

from wayfold.llm import common, op05_bpe, op07_decontamination, op08_secrets


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    assert op08_secrets.scan(spark.read.parquet(str(tmp_path / "3"))).where("size(spans_assign) + size(spans_access) + size(spans_hex) > 0").count() == 0
    assert p.run(spark, sf_dir).count() == kept[-1]


def test_odd_rows(spark, odd_rows, sf_dir):
    given = odd_rows.select("doc_id", "text", "lang", "source", "n_chars")
    more = ("row", "_row", "_Leaks", "leaks", "_rules", "_key", "spans_hex", "_spans_hex", "n_words", "kept", "_group", "v_words", "document", "id", "fp")
    docs = given.withColumns({c: F.lit(k) for k, c in enumerate(more)})
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == tuple(range(len(more))) for r in out.collect())
        else:
            assert out.count() == 10
    one = [r.doc_id for r in p.near_dedup(spark, docs, sf_dir).collect()]
    assert one.count(6) == 1 and None in one and len([x for x in one if x in (2, 3, 4)]) == 1
    assert p.secrets(spark, docs, sf_dir).count() == p.decontaminate(spark, docs, sf_dir).count() == 10
    many = docs.where("doc_id = 5").withColumn("n_chars", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    assert p.near_dedup(spark, many, sf_dir).count() == 1


def test_rows_that_differ_only_by_where_a_null_stands_are_two(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, " ".join(f"w{(k * 7919 + i * 104729) % 5003}" for i in range(60 + k % 40)), "en", "s", 1) for k in range(50)]
    docs = spark.createDataFrame([*rows, (100, text, "en", None, 1), (100, text, None, "en", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.quality(spark, docs, sf_dir).where("doc_id = 100").count() == 2
    assert p.near_dedup(spark, docs, sf_dir).where("doc_id = 100").count() == 1


def words_of(text):
    raw = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def test_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept, computed again text by text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {name: stage for name, stage in p.STAGES}
    kept = p.quality(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in kept.collect()}
    every = {r.doc_id: r.text for r in docs.collect()}
    assert not any(slow_statistics(every[k])[0] < 20 or 100 * slow_statistics(every[k])[4] > 30 * slow_statistics(every[k])[0] for k in texts)

    # near-duplicates: all pairs by exact Jaccard similarity of five-word shingles
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    single = p.near_dedup(spark, kept, sf_dir)
    assert {r.doc_id for r in single.collect()} == {k for k in texts if find(k) == k}

    # benchmark: the least edit distance of every item to any stretch of every document
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    codes = {}
    items = [np.array([codes.setdefault(w, len(codes)) for w in x]) for x in items if x]
    clean = p.decontaminate(spark, single, sf_dir)
    for k in (r.doc_id for r in single.select("doc_id").collect()):
        own = np.array([codes.setdefault(w, len(codes)) for w in words_of(texts[k])], np.int64)
        texts[k] = texts[k], any(op07_decontamination.nearest(x, own)[0] <= op07_decontamination.edits(len(x)) for x in items)
    assert {r.doc_id for r in clean.collect()} == {k for k, t in texts.items() if isinstance(t, tuple) and not t[1]}

    # secrets: spans of all rules, merged where they meet
    masked = {r.doc_id: r.text for r in p.secrets(spark, clean, sf_dir).collect()}
    for k, text in masked.items():
        spans, out, at = [], "", 0
        for r in op08_secrets.RULES:
            spans += [m.span() for m in re.finditer(r.pattern, texts[k][0], (re.I if r.any_case else 0) | re.A) if len(m.group(r.group)) >= r.least]
        for i, (a, b) in enumerate(sorted(spans)):
            if not i or a > at:
                out += texts[k][0][at:a] + "[SECRET]"
            at = max(at, b)
        assert text == out + texts[k][0][at:]

    # tokens
    for r in after["byte-level BPE encoding and decoding"](spark, p.secrets(spark, clean, sf_dir), sf_dir).collect():
        ids = op05_bpe.encoding().encode_ordinary(masked[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(masked[r.doc_id].encode()).hexdigest())


def test_tables_of_earlier_stages_go_once_they_are_not_read(spark, sf_dir):
    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages["quality rules"](spark, docs, sf_dir)
    (table,) = [n for n in common._made["pipeline"] if spark.catalog.tableExists(n)]
    single = stages["SimHash near-dedup"](spark, kept, sf_dir)  # reads the stage before, which is not written
    assert spark.catalog.tableExists(table) and single.count() > 100
    stages["secret scans"](spark, docs, sf_dir)
    assert not spark.catalog.tableExists(table) and not common._made["pipeline"]
