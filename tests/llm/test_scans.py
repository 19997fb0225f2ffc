"""License, secret, quality and benchmark scans against brute force."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import oracle
import pytest
from words import text_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import op06_licenses, op07_decontamination, op08_secrets, op09_quality, queries
from wayfold.llm.trigrams import query, trigrams

FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_licenses(spark, odd_rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_001, "x\nMIT License, apache-license; CC BY and GNU General\nPublic License"), (10_002, "Permission is hereby granted free of charge to any person obtaining a copy of software and documentation files"), (10_003, None)], docs.schema)
    df = docs.unionByName(extra)
    rows = {r.doc_id: r for r in op06_licenses.scan(df).collect()}
    templates = {k: words_of(v) for k, v in op06_licenses.TEMPLATES.items()}
    for d, text in df.collect():
        w = words_of(text)
        at = sorted((i, label) for phrase, label in op06_licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        want = slow_blocks(w, templates)
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and r.labels == ",".join(sorted({label for _, label in at} | want.keys()))
        assert r.score == (1.0 if at else max([0.0, *want.values()])) and {m.template for m in r.matches} == want.keys()
    assert rows[10_001].n_base == 4 and "mit-terms" in rows[10_002].labels
    assert op06_licenses.scan(odd_rows).count() == 10 and op06_licenses.scan(odd_rows.where("false")).count() == 0


def slow_blocks(w, templates, threshold=0.8):
    """The fullest block of each template that some block matches, over all runs of words."""
    out = {}
    for name, t in templates.items():
        n, span = len(set(t)), math.ceil(len(t) / threshold)
        if len(set(t) & set(w)) >= threshold * n:
            best = max(len(set(t) & set(w[i : i + span])) for i in range(len(w)))
            if best >= threshold * n:
                out[name] = best / n
    return out


def test_license_blocks_reach_over_lines_and_no_further(spark):
    words = [w for t in op06_licenses.TEMPLATES.values() for w in words_of(t)]
    rng = random.Random(2)
    texts = []
    for name in ("mit", "bsd-2-clause", "gpl-terms", "isc", "apache-2.0-notice"):
        own = op06_licenses.TEMPLATES[name].split()
        wrapped = "".join(w + ("\n # " if k % 9 == 8 else " ") for k, w in enumerate(own))
        texts += ["int x; " * 20 + wrapped + "int y; " * 20, " ".join(w + " filler" * 9 for w in own), " ".join(w for k, w in enumerate(own) if k % 6)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = {k: words_of(v) for k, v in op06_licenses.TEMPLATES.items()}
    for r in op06_licenses.scan(df).collect():
        want = slow_blocks(words_of(texts[r.doc_id]), templates)
        assert {m.template for m in r.matches} == want.keys(), r.doc_id
        for name, share in want.items():
            assert max(m.containment for m in r.matches if m.template == name) == share
    labels = [r.labels for r in op06_licenses.scan(df).orderBy("doc_id").collect()]
    assert "mit" in labels[0].split(",") and "bsd-2-clause" in labels[3] and labels[1] == "" and "mit" in labels[2].split(",")


def test_each_license_filter_rejects_and_none_loses_a_match():
    rng = random.Random(5)
    name, template = "t", " ".join(f"w{i}" for i in range(20))
    counts = {int(c): i + 1 for i, c in enumerate(op06_licenses._codes([template])[0])}  # w0 is the rarest
    known = op06_licenses.Templates({name: template}, counts, 0.8)
    assert (known.size[0], known.need[0], known.span[0]) == (20, 16, 25)
    short = "w2 " * 3 + "w9"
    far = "w1 " + "x " * 40 + " ".join(f"w{i}" for i in range(5, 20))
    later = "w4 " * 2 + "w0 w1 w2 w3 " * 3 + " ".join(f"w{i}" for i in range(5, 12))  # enough words about w4, too few behind it in the order
    texts = [short, far, later, template]
    texts += [" ".join(rng.choice([f"w{rng.randrange(20)}", "x"] if rng.random() < 0.3 else [f"w{j % 20}"]) for j in range(rng.randrange(120))) for _ in range(400)]
    words = op06_licenses.Words(op06_licenses.pa.array(texts))
    at = np.minimum(np.searchsorted(known.words, words.code), len(known.words) - 1)
    rank = np.where(known.words[at] == words.code, known.rank[0][at], -1)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    found = known.candidates(0, np.arange(len(rank)), rank, owner, words.first)
    prefix, long, left = ({(int(owner[i]), int(rank[i])) for i in x} for x in found)
    at_lead = rank[owner == 2]
    assert (at_lead >= 0).sum() >= 16 > (at_lead >= 4).sum()
    assert {(0, 2), (1, 1), (2, 4), (3, 0)} <= prefix and (0, 2) not in long and {(1, 1), (2, 4)} <= long - left and {(2, 0), (3, 0)} <= left
    left = {d for d, _ in left}
    want = {d: best[name] for d, t in enumerate(texts) if (best := slow_blocks(t.split(), {name: template.split()}))}
    got: dict[int, float] = {}
    for d, _, _, share in known.matches(words.code, words.first):
        got[d] = max(share, got.get(d, 0))
    assert got == want and want.keys() <= left and 3 in want and len(want) > 20


def slow_spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", (re.I if r.any_case else 0) | re.A):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


SECRETS = [
    "token=token:abcdefg", 'my API_KEY = "abc123XYZ" é🙂 password: short', "AKIA" + "B" * 16 + " AKIA1", "0" * 23 + "g" + "a1" * 12 + "\n" + "b" * 30,
    "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "ghp_" + "a" * 36, "apikey='" + "A" * 6 + "'passwd==abcdef", "Secret\x20\x20:\x20" + "x" * 700, " ".join(f"token=abc{k}def" for k in range(700)), "sk_live_" + "0a" * 12, "eyJabc.eyJdef.ghijklmnopqrstuvwxyz0123",
]


def test_secrets(spark, odd_rows):
    rows = [(k, t, "x") for k, t in enumerate([*SECRETS, "", None])]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, _rules string")
    df = df.withColumns({c: F.lit(k) for k, c in enumerate(("_key", "_row", "_Every", "_spans_hex"))})
    base = tuple(r for r in op08_secrets.RULES if r.base)
    got = op08_secrets.scan(df.withColumn("spans_hex", F.lit(7))).select("doc_id", "text", op08_secrets.listing(op08_secrets.RULES).alias("all"), op08_secrets.listing(base).alias("base")).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r["all"] == slow_spans(r.text, op08_secrets.RULES) and r.base == slow_spans(r.text, base)
    assert op08_secrets.scan(odd_rows).count() == 10 and op08_secrets.scan(odd_rows.where("false")).count() == 0
    out = op08_secrets.redact(df.withColumn("spans_hex", F.lit(7)))
    assert out.columns == [*df.columns, "spans_hex"]
    assert {tuple(r)[2:] for r in out.collect()} == {("x", 0, 1, 2, 3, 7)}
    masked = {r.doc_id: r.text for r in out.collect()}
    assert masked[1] == 'my [SECRET]" é🙂 password: short' and masked[len(SECRETS)] == "" and masked[len(SECRETS) + 1] is None
    assert all(not slow_spans(t, op08_secrets.RULES) for t in masked.values())


def test_secrets_of_a_long_text(spark):
    """Five million characters with a hundred thousand hex runs: the work grows with the text."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["0123456789abcdef" * 2, "deadbeef" * 2, "é🙂 abc", "feed"]) for _ in range(280_000))
    df = spark.createDataFrame([(1, text), (2, text[:100])], "doc_id long, text string")
    began = time.time()
    one = op08_secrets.scan(df).orderBy("doc_id").first()
    masked = op08_secrets.redact(df).orderBy("doc_id").first().text
    assert time.time() - began < 90
    want = [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [(s.start, s.end) for s in one.spans_hex] == want and len(want) > 60_000
    assert masked == re.sub("[0-9a-f]{24,}", "[SECRET]", text)


def test_secrets_by_many_rules(spark):
    """More mandatory trigrams than one word has bits."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("bcdfghkmnpqrstvwxz") for _ in range(5)) for _ in range(120)})
    rules = tuple(op08_secrets.Rule(name, rf"{name}_[A-Z0-9]+", 12) for name in names)
    assert len(set().union(*(trigrams(query(r.pattern)) for r in rules))) > 3 * op08_secrets.WORD
    texts = [" ".join(f"{name}_{'A1' * rng.randint(2, 9)} {name[1:]}_AAAAAAAA" for name in rng.sample(names, 3)) for _ in range(60)] + ["", None, names[0], f"{names[-1]}_{'Z' * 30}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.all for r in op08_secrets.scan(df, rules=rules).select("doc_id", op08_secrets.listing(rules).alias("all")).collect()}
    assert got == {k: slow_spans(t, rules) for k, t in enumerate(texts)} and got[63]


def test_repeats_that_coincide_are_no_few_strings():
    q = query("(a|aa|b|bb|ab|ba){1,4}xyz")
    met = lambda q, t: True if q is True else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(met(x, t) for x in q[1])
    assert all(met(q, "".join(p) + "xyz") for n in range(1, 5) for p in itertools.product(("a", "aa", "b", "bb", "ab", "ba"), repeat=n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ":", "secret", "PassWord", "api", "_key", "abcdef", "12", " ", "'", "AKIA", "ABCDEFGHIJKLMNOP", "xoxb-", "é"]), max_size=14))
def test_trigram_queries_never_lose_a_match(parts):
    text = "".join(parts)

    def met(q):
        return True if q is True else q in text.lower() if isinstance(q, str) else (all if q[0] == "and" else any)(map(met, q[1]))

    for r in op08_secrets.RULES:
        if re.search(r.java, text):
            assert met(query(r.pattern))
    assert query("[0-9a-f]+") is True and query("abc") == "abc"


def slow_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 4000 else set()
    places = {i + j for i, g in enumerate(grams) if g in many for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(places)


def test_statistics(spark, odd_rows):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["a\nb\na\n \n\na", "x#y |z<>　é", "w " * 8, "w " * 9, None, "", " \x0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in op09_quality.statistics(df).collect():
        assert tuple(r[n] for n in names) == slow_statistics(r.text), r.text
    rows = op09_quality.judge(odd_rows).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows if r.doc_id != 5 and r.doc_id is not None and r.n_words < 20)
    assert op09_quality.judge(odd_rows.where("false")).count() == 0


def test_outliers_by_group(spark):
    rng = random.Random(6)
    rows = [(k, f"s{k % 2}", *(rng.gauss(0, 1) for _ in range(5))) for k in range(1200)] + [(5000 + k, "s0", 30.0, -30.0, 0.0, 0.0, 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{v} double" for v in op09_quality.VECTOR)).withColumn("lang", F.lit("en"))
    far = {r.doc_id for r in op09_quality.outliers(df).where(F.col("distance2") > op09_quality.CUTOFF).collect()}
    assert far == {5000 + k for k in range(20)}


def edit_distance(item, words):
    best = (len(item), 0)
    for a in range(len(words) + 1):
        row = list(range(len(item) + 1))
        for b in range(a, min(len(words), a + 2 * len(item))):
            new = [b - a + 1]
            for i, x in enumerate(item):
                new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != words[b])))
            row = new
            best = min(best, (row[-1], a))
    return best[0]


def test_decontamination(spark, odd_rows):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    items = [rng.choices(words, k=n) for n in (12, 20, 33, 47)]
    docs, truth = [], []
    for k in range(120):
        d = rng.choices(words, k=rng.randrange(0, 120))
        if k % 2:
            item = items[k % 4][:]
            for _ in range(rng.randrange(0, op07_decontamination.edits(len(item)) + 3)):
                p = rng.randrange(len(item))
                item[p : p + 1] = rng.choice([[], ["new"], [item[p], "new"]])
            p = rng.randrange(len(d) + 1)
            d[p:p] = item
        docs.append(d)
        truth.append({i for i, x in enumerate(items) if edit_distance(x, d) <= op07_decontamination.edits(len(x))})
    df = spark.createDataFrame([(k, text_of(d).upper() if k % 3 else text_of(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([*((k, text_of(x)) for k, x in enumerate(items)), (99, None), (98, "")], "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in op07_decontamination.scan(df, bench).collect()}
    found = sum(len(got[k] & t) for k, t in enumerate(truth))
    assert all(got[k] <= t for k, t in enumerate(truth))  # verified exactly
    assert found >= 0.97 * sum(map(len, truth))
    assert op07_decontamination.scan(odd_rows, bench).count() == 10
    assert op07_decontamination.scan(odd_rows, bench.where("false")).where(F.size("leaks") > 0).count() == 0


@pytest.mark.parametrize("name", ["op8_secrets", "op6_licenses", "op9_quality"])
def test_registered_queries_return_every_document(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_hex_of_base(spark, sf_dir):
    rows = queries.op8_secrets(spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    base = tuple(r for r in op08_secrets.RULES if r.base)
    assert all(r.base_sha256 == hashlib.sha256(slow_spans(texts[r.doc_id], base).encode()).hexdigest() for r in rows)


def test_estimate_has_the_least_determinant(spark):
    """Concentration ends no higher than the best of many random starts in numpy."""
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5))
    x = rng.normal(size=(240, 5)) @ mix
    x[:50] = rng.normal(size=(50, 5)) * 0.3 + 25  # a fifth of the rows stands apart
    rows = [tuple(map(float, r)) for r in x]
    members = spark.createDataFrame(rows, ", ".join(f"{v} double" for v in op09_quality.VECTOR)).withColumn("_group", F.lit("all"))
    found = op09_quality._concentrated(members).first()
    own = np.array([[found[f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
    floor, least, h = np.eye(5) * op09_quality.FLOOR, np.inf, int(op09_quality.CORE * len(x))
    for _ in range(200):
        core = x[rng.choice(len(x), 7, replace=False)]
        for _ in range(12):
            mean, cov = core.mean(0), np.cov(core.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            core = x[np.argsort(d)[:h]]
        least = min(least, np.linalg.det(np.cov(core.T, bias=True) + floor))
    assert np.linalg.det(own + floor) <= 1.05 * least


def test_small_groups_lean_on_the_wider_level(spark):
    """The weight of a group's own rows grows with their number, without a step."""
    rng = random.Random(9)
    rows = [("en", "hot", *(rng.gauss(0, 1) for _ in range(5))) for _ in range(4000)]
    rows += [("en", f"s{n}", *(rng.gauss(4, 1) for _ in range(5))) for n in (10, 40, 160, 640) for _ in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} double" for v in op09_quality.VECTOR))
    far = {r.source: r.d for r in op09_quality.outliers(df).groupBy("source").agg(F.percentile("distance2", 0.5).alias("d")).collect()}
    assert far["s10"] > far["s40"] > far["s160"] > far["s640"], far


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_base_columns_agree_with_sql(spark, sf_dir, name):
    assert oracle.difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir) is None


def test_decontamination_of_odd_rows(spark, odd_rows):
    """Empty tables on both sides, one-word items, and a long text with an item at its end."""
    none = spark.createDataFrame([], "item_id long, text string")
    assert op07_decontamination.scan(odd_rows.where("false"), none).count() == 0
    assert op07_decontamination.scan(odd_rows.withColumn("Leaks", F.lit(3)), none).select("leaks").distinct().collect()[0].leaks == []
    item = [f"q{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, text_of(item)), (2, "lonely")], "item_id long, text string")
    long = text_of([f"w{k % 977}" for k in range(60_000)] + item[:14] + ["new"] + item[15:])
    df = spark.createDataFrame([(1, long), (2, "a lonely word"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(x.item_id, x.start_word, x.distance) for x in r.leaks] for r in op07_decontamination.scan(df, bench).collect()}
    assert got == {1: [(1, 60_000, 1)], 2: [(2, 1, 0)], 3: []}


def test_quality_factor_is_one_projection(spark):
    """The covariance's factor equals NumPy's and takes a few projections, not one an entry, whose generated code grew beyond a method's bounds."""
    rng = np.random.default_rng(5)
    pairs, rows, want = op09_quality._PAIRS, [], []
    for g in range(4):
        z = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5))
        c = np.cov(z.T, bias=True)
        rows.append((str(g), *[0.0] * 5, *(float(c[i, j]) for i, j in pairs)))
        want.append(np.linalg.cholesky(c + op09_quality.FLOOR * np.eye(5)))
    df = op09_quality._factored(spark.createDataFrame(rows, ["_group", *op09_quality._MOMENTS]))
    for r, low in zip(sorted(df.collect()), want, strict=True):
        np.testing.assert_allclose([r[f"l{i}{j}"] for i, j in pairs], [low[i, j] for i, j in pairs], rtol=1e-9)
        assert abs(r["_logdet"] - 2 * np.log(np.diag(low)).sum()) < 1e-9
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Project [") <= 5
