"""Language identification and toxicity: exact code lengths, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayfold.llm import op03_langid, op04_toxicity, op09_quality, queries
from wayfold.llm.common import text_bytes


def slow_length(text, grams):
    """Escape-coded length of a folded text, straight from the counts of one language."""
    raw = b"\n\n\n" + text.encode()
    by = [Counter() for _ in range(4)]
    for gram, n in grams.items():
        ctx, s = gram[:3], gram[3]
        for k in range(4):
            by[k][ctx[3 - k :], s] += n
    total, kinds = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for k in range(4):
        for (ctx, _), n in by[k].items():
            total[k][ctx] += n
            kinds[k][ctx] += 1

    def p(k, ctx, s):
        if k < 0:
            return 1 / 256
        below = p(k - 1, ctx[1:], s) if k else 1 / 256
        if not total[k][ctx]:
            return below
        whole = total[k][ctx] + kinds[k][ctx]
        return by[k][ctx, s] / whole if by[k][ctx, s] else kinds[k][ctx] / whole * below

    return sum(-math.log2(p(3, raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))


def test_code_lengths():
    samples = {"aa": ["banana bandana", "an ant"], "bb": ["xylo box", "oxen xx"]}
    rows, grams = [], {}
    for lang, texts in samples.items():
        own = Counter()
        for t in texts:
            raw = b"\n\n\n" + t.encode()
            own.update(raw[i - 3 : i + 1] for i in range(3, len(raw)))
        grams[lang] = own
        rows += [(lang, int.from_bytes(g, "big"), n) for g, n in own.items()]
    model = op03_langid.Model(rows, min_count=1)
    texts = ["banana", "box of ants", "zzz", ""]
    got = model.lengths(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[k, j] / op03_langid.UNIT - slow_length(t, grams[lang])) < 0.01


def test_sixty_languages_need_the_sum_of_their_tables():
    """Each with 8,000 grams: groups do not change a code length, and the size grows with the languages."""
    rng = np.random.default_rng(4)
    rows, sizes = [], {}
    for k in range(60):
        letters = rng.permutation(np.r_[97:123, 195 + k % 4, 160 + np.arange(20)])[:30]
        grams = np.unique(sum(rng.choice(letters, 12_000) << s for s in (0, 8, 16, 24)))[:8000]
        rows += [(f"l{k:02d}", int(g), int(n)) for g, n in zip(grams, rng.integers(1, 9, len(grams)), strict=True)]
        if k + 1 in (15, 30, 60):
            model = op03_langid.Model(rows)
            sizes[k + 1] = model.nbytes
    assert len(model.langs) == 60 and sizes[60] < 2.2 * sizes[30] < 4.6 * sizes[15] and sizes[60] < 400 << 20
    raw, offsets = text_bytes(pa.array(["".join(map(chr, rng.integers(97, 123, 50))) for _ in range(20)] + ["", "é à ü"]))
    got = model.lengths(raw, offsets)
    few = [r for r in rows if r[0] in ("l07", "l31")]
    for most in (1, 1 << 30):
        assert (op03_langid.Model(few, most=most).lengths(raw, offsets) == got[:, [7, 31]]).all()


def test_languages(spark, sf_dir):
    rows = queries.op3_language_id(spark, sf_dir)
    known = rows.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(known) > 10 and (known.lang_pred == known.lang).mean() >= 0.95


def test_odd_rows(spark, odd_rows):
    model = op03_langid.train(odd_rows)
    rows = op03_langid.predict(odd_rows, model, extra={"mark": F.col("lang")}).collect()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 10 and pred[1][0] == "de" and pred[5][0] == "en"
    assert pred[2] == pred[3] == pred[4] == pred[8] == ("und", 0.0)
    nothing = op03_langid.predict(odd_rows, op03_langid.train(odd_rows.where("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert op03_langid.predict(odd_rows.where("false"), model).count() == 0


def test_toxicity(spark, tmp_path):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("ta", "ro", "mi", "lu", "ke") for b in ("na", "so", "ri", "pel", "dun")]
    rows = []
    for k in range(900):
        words = list(rng.choice(plain, rng.integers(20, 200)))
        bad = k % 7 == 0
        if bad:
            for i in range(0, len(words), 25):
                words[i] = "vilefool"
        rows.append((k, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op04_toxicity.train(df.where("doc_id % 3 <> 0"), "toxic")
    out = op04_toxicity.predict(df, model, extra={"toxic": F.col("toxic")}).where("doc_id % 3 = 0").toPandas()
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() >= 0.97 and out.score.between(0, 1).all()


def test_toxicity_odd_rows(spark, odd_rows):
    marked = odd_rows.withColumn("y", F.when(F.col("doc_id") < 3, 1).when(F.col("doc_id") < 7, 0))
    model = op04_toxicity.train(marked, "y")
    rows = op04_toxicity.predict(odd_rows, model).collect()
    assert len(rows) == 10 and len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    for one in (marked.where("y = 0"), marked.where("false")):
        assert {r.predicted for r in op04_toxicity.predict(odd_rows, op04_toxicity.train(one, "y")).collect()} == {0}


def test_quality_of_small_groups_is_judged_by_all_rows_of_the_wider_level(spark):
    rng = random.Random(4)

    def text(n, form="w{}"):
        return " ".join(form.format(rng.randrange(10**6)) for _ in range(n))

    rows = [(k, text(rng.randrange(60, 2500)), "en", "hot") for k in range(300)]
    rows += [(1000, text(100, "#$%&{}"), "en", "single"), (1001, text(300), "en", "other"), (1002, text(100, "#$%&{}"), "xx", "single"), (1003, text(300), "yy", "single")]
    rows += [(2000 + k, text(2000 if k == 4 else 100), "en", "five") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in op09_quality.judge(df).where("doc_id >= 1000").collect()}
    assert kept == {1000: False, 1001: True, 1002: False, 1003: True, **{2000 + k: True for k in range(5)}}


def slow_rates(text):
    """Rates of hashed grams, place by place, over Python strings of bytes."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    raw = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in raw)
    counts = Counter()
    for order in op04_toxicity.ORDERS:
        for i in range(len(raw) - order + 1):
            h = int.from_bytes(raw[i : i + order], "little") * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * order) % 2**64
            counts[h >> (64 - op04_toxicity.BITS)] += 1
    n = len(raw.split())
    return {p: c / (op04_toxicity.RATE * (n + op04_toxicity.SMOOTH)) for p, c in counts.items()}


def test_rates_and_scores_by_brute_force():
    texts = ["Alpha beta, alpha!", "", None, "x", "naïve käse 12 " * 9, "abc"]
    raw, offsets = text_bytes(pa.array(texts))
    doc, place, rate = op04_toxicity.rates(raw, offsets)
    rng = np.random.default_rng(0)
    weight = rng.normal(size=op04_toxicity.SIZE)
    score = op04_toxicity.Model(weight, 0.3).score(raw, offsets)
    for k, t in enumerate(texts):
        want = slow_rates(t or "")
        got = dict(zip(place[doc == k].tolist(), rate[doc == k].tolist(), strict=True))
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        z = 0.3 + sum(weight[p] * r for p, r in want.items())
        assert abs(score[k] - 1 / (1 + math.exp(-min(50, max(-50, z))))) < 1e-9


def test_fit_is_the_ridge_logistic_regression_over_scaled_rates(spark):
    """Ratios and the minimum are computed again in plain numpy on few texts."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ta", "ro", "mi") for b in ("na", "so", "ri")]
    rows = [(k, " ".join([*rng.choices(words, k=30), *(["vilefool"] * (k % 4 == 0))]), int(k % 4 == 0)) for k in range(60)]
    model = op04_toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "toxic")
    rates = [slow_rates(t) for _, t, _ in rows]
    places = sorted({p for r in rates for p in r})
    x = np.array([[r.get(p, 0.0) for p in places] for r in rates])
    y = np.array([r[2] for r in rows], float)
    p, q = (np.ones(op04_toxicity.SIZE) for _ in range(2))
    p[places] += x[y == 1].sum(0)
    q[places] += x[y == 0].sum(0)
    ratio = np.log((p / p.sum()) / (q / q.sum()))[places]
    z = x * ratio

    def loss(w):
        m = z @ w[:-1] + w[-1]
        return (np.logaddexp(0, m) - y * m).mean() + op04_toxicity.RIDGE / 2 * w[:-1] @ w[:-1]

    own = np.append(model.weight[places] / np.where(ratio == 0, 1, ratio), model.bias)
    start = np.append(np.zeros(len(places)), np.log(y.mean() / (1 - y.mean())))
    best = op04_toxicity.minimized(lambda w: (loss(w), np.append(z.T @ ((s := 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))) - y) / len(y) + op04_toxicity.RIDGE * w[:-1], (s - y).mean())), start, 60)
    assert loss(own) < 0.25 * loss(start) and loss(own) <= loss(best) + 0.05
    outside = np.ones(op04_toxicity.SIZE, bool)
    outside[places] = False
    assert np.abs(model.weight[outside]).max() < 1e-6


def test_minimum_of_a_quadratic():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 12))
    a, b = a @ a.T + np.eye(12), rng.normal(size=12)
    at = op04_toxicity.minimized(lambda w: (w @ a @ w / 2 - b @ w, a @ w - b), np.zeros(12), 80)
    assert np.allclose(at, np.linalg.solve(a, b), atol=0.1)


def test_equal_languages_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([(k, "one two three four", lang) for k, lang in enumerate(["bb", "aa"] * 3)], "doc_id long, text string, lang string")
    rows = op03_langid.predict(df, op03_langid.train(df)).collect()
    assert {r.lang_pred for r in rows} == {"aa"} and {r.score for r in rows} == {0.5}


def slow_factor(m, c):
    return np.linalg.cholesky(c + op09_quality.FLOOR * np.eye(5))


def slow_square(x, m, c):
    y = np.linalg.solve(slow_factor(m, c), (x - m).T)
    return (y * y).sum(0)


def slow_rank(values, share):
    return np.sort(values, axis=0)[math.ceil(share * len(values)) - 1]


def slow_verdicts(x, groups):
    """Squared distances by the whole method; ``groups`` holds each row's keys, widest first."""
    q = op09_quality
    keys = sorted({g for row in groups for g in row})
    rows = {g: x[[g in row for row in groups]] for g in keys}
    at = {}
    for g, own in rows.items():
        mid = slow_rank(own, 0.5)
        spread = 1.4826 * slow_rank(np.abs(own - mid), 0.5) + q.FLOOR**0.5
        z = (own - mid) / spread
        z = z / np.sqrt((z * z).sum(1) + 1e-12)[:, None]
        scale = np.outer(spread, spread)
        at[g, 0], at[g, 1] = (mid, np.eye(5) * scale), (mid, 5 * (z.T @ z) / len(z) * scale)

    def size(m, c):
        return 2 * np.log(np.diag(slow_factor(m, c))).sum()

    for step in range(q.STEPS):
        fell = []
        for key, (m, c) in at.items():
            own = rows[key[0]]
            d2 = slow_square(own, m, c)
            core = own[d2 <= slow_rank(d2, q.CORE)]
            at[key] = core.mean(0), np.cov(core.T, bias=True)
            fell.append(size(m, c) - size(*at[key]))
        if step and max(fell) < 0.01:
            break
    level = {}
    for g in sorted(keys, key=lambda g: g.count("/")):
        m, c = min((at[g, k] for k in (0, 1)), key=lambda mc: size(*mc))
        c = c * max(slow_rank(slow_square(rows[g], m, c), 0.5) / q.MEDIAN, 1)
        if "/" in g:
            up, share = level[g.rsplit("/", 1)[0]], len(rows[g]) / (len(rows[g]) + q.PRIOR)
            m, c = share * m + (1 - share) * up[0], share * c + (1 - share) * up[1]
        level[g] = m, c
    return np.array([slow_square(v[None], *level[row[-1]])[0] for v, row in zip(x, groups, strict=True)])


def test_quality_verdicts_by_the_whole_method(spark):
    rng = random.Random(11)
    rows = []
    for k in range(360):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 11))) for _ in range(int(rng.lognormvariate(4.3, 0.5)) + 5)]
        if k % 5 == 0:
            words = [w if rng.random() < 0.9 else "#$" + w for w in words]
        if k % 40 == 7:
            words = ["*#$%&|<>" * 4 for _ in words]
        if k % 40 == 9:
            words = ["x" * 60 for _ in words[:25]]
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        if k % 9 == 0:
            lines += lines[: len(lines) // 3]
        rows.append((k, rng.choice(["en", "en", "de", None]), rng.choice(["web", "web", "book", None]), "\n".join(lines)))
    rows += [(k + 1000, *r[1:]) for k, r in enumerate(rows[:20])]
    got = {r.doc_id: r for r in op09_quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    x, groups = [], []
    for k, lang, source, text in rows:
        r, n_lines = got[k], sum(bool(line.strip()) for line in text.split("\n"))
        x.append([math.log1p(r.n_words) / 2, math.log(r.word_chars / r.n_words), math.sqrt(r.n_symbols / r.word_chars) * 2, r.n_dup_lines / n_lines / 2, r.n_repeat_words / r.n_words])
        groups.append(("all", f"all/{lang}", f"all/{lang}/{source}"))
    want = slow_verdicts(np.array(x), groups)
    assert np.allclose([got[r[0]].distance2 for r in rows], want, rtol=1e-6, atol=1e-9)
    assert [got[r[0]].kept for r in rows] == [not got[r[0]].base_failed and d <= op09_quality.CUTOFF for r, d in zip(rows, want, strict=True)]
    assert 10 < sum(d > op09_quality.CUTOFF for d in want) < 60
