"""Quality rules: text statistics, hard rules, and robust multivariate outliers.

The statistics become a vector of five transformed values. For all rows, each
language, and each language and source, a minimum-covariance-determinant
estimate is found by concentration steps: keep the share ``CORE`` of rows with
the smallest distances, take their mean and covariance, repeat until no
determinant falls any more (``STEPS`` at most). Two starts are tried, medians
with absolute deviations and the covariance of signs about the medians; the one
that ends with the smaller determinant counts. A squared Mahalanobis distance
over ``CUTOFF`` is rejected.

A group of n rows weighs n against ``PRIOR`` rows of the next wider level, in
mean and covariance alike, at every size: a rare source is judged almost as its
language, a large one almost by itself. ``FLOOR`` is added to the variances, so
a statistic that is constant in a group does not reject a row for a hair's
difference. Everything is DataFrame aggregation; a step is two small group-bys
over the statistics, written once to the shared folder, never over the texts.

Defined cases: null and empty text has no words and fails the hard rules; very
long texts are taken whole; null language or source is a group of its own;
repeated rows are rows and weigh as such; rows of equal distance share their
verdict; other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.llm.common import SMALL, counted, materialize, small, stored, unused

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
CORE = 0.75
STEPS = 8
PRIOR = 50
#: Squared distance beyond which a row is an outlier: chi-square with five degrees exceeds it once in 10**11, as clean texts have longer tails than normal ones.
CUTOFF = 60.0
#: Median of chi-square with five degrees of freedom.
MEDIAN = 4.3515
FLOOR = 0.005
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
VECTOR = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, computed once although ``body`` uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, window: int) -> Column:
    """Places in windows of ``window`` words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        def spread(ordered: Column) -> Column:
            last = F.size(ordered)
            twice = F.filter(ordered, lambda x, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | ((j + 1 < last) & (F.get(ordered, j + 1)["h"] == x["h"])))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return _bind(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).alias("n"), i.alias("last")), lambda a: a["n"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(pairs, spread))

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(codes, i, F.lit(window))))

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 2, F.lit(0)).when(F.size(words) <= window, F.lit(0)).otherwise(_bind(_bind(codes, windows), covered))


def statistics(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Append ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines`` and ``n_repeat_words``."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    w, rows = unused(df, "_words"), unused(df, "_lines")
    out = df.withColumns({w: words, rows: lines})
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(value) - F.length(F.regexp_replace(value, "[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size(rows).cast("long"),
            "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w), window).cast("long"),
        }
    ).drop(w, rows)


def failed(min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def vector() -> dict[str, Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "v_words": F.log1p("n_words") / 2,
        "v_length": F.log(chars / n),
        "v_symbols": F.sqrt(F.col("n_symbols") / chars) * 2,
        "v_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)) / 2,
        "v_repeats": F.col("n_repeat_words") / n,
    }


_P = range(len(VECTOR))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_MOMENTS = [*(f"m{i}" for i in _P), *(f"c{i}{j}" for i, j in _PAIRS)]


def _factored(moments: DataFrame) -> DataFrame:
    """Append the Cholesky factor of the covariance plus the floor, and the logarithm of its determinant.

    The factor is an array that grows entry by entry: a column for each entry would be a projection each, and the driver's generated code would pass a method's bounds.
    """
    covariance, factor = unused(moments, "_cov"), unused(moments, "_factor")
    places = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(i * (i + 1) // 2 + 1).alias("row"), F.lit(j * (j + 1) // 2 + 1).alias("col"), F.lit(j).alias("k"), F.lit(i == j).alias("own")) for p, (i, j) in enumerate(_PAIRS)))

    def entry(known: Column, at: Column) -> Column:
        products = F.zip_with(F.slice(known, at["row"], at["k"]), F.slice(known, at["col"], at["k"]), lambda x, y: x * y)
        start = F.get(F.col(covariance), at["p"]) + F.when(at["own"], F.lit(FLOOR)).otherwise(F.lit(0.0))
        value = _bind(F.aggregate(products, start, lambda rest, x: rest - x), lambda rest: F.when(at["own"], F.sqrt(F.greatest(rest, F.lit(1e-9)))).otherwise(rest / F.get(known, at["col"] + at["k"] - 1)))
        return F.concat(known, F.array(value))

    rows = moments.withColumn(covariance, F.array(*(F.col(f"c{i}{j}") for i, j in _PAIRS)))
    rows = rows.withColumn(factor, F.aggregate(places, F.array().cast("array<double>"), entry))
    rows = rows.withColumns({f"l{i}{j}": F.get(factor, p) for p, (i, j) in enumerate(_PAIRS)}).drop(covariance, factor)
    return rows.withColumn("_logdet", sum((2 * F.log(f"l{i}{i}") for i in _P), F.lit(0.0)))


def _moments(rows: DataFrame, *by: str, before: Column) -> DataFrame:
    return rows.groupBy(*by).agg(before.alias("_before"), *(F.avg(VECTOR[i]).alias(f"m{i}") for i in _P), *(F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i, j in _PAIRS))


def _distances(rows: DataFrame, params: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``_d2``, the squared Mahalanobis distance by forward substitution."""
    out = rows.join(params, "_group")
    for i in _P:
        rest = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("_d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in _P), F.lit(0.0))).select(*keep, "_d2")


def _starts(members: DataFrame) -> DataFrame:
    """Two starting estimates of each group: ``_group, _start`` and the moments."""
    medians = small(members.groupBy("_group").agg(*(F.percentile_approx(v, 0.5, 1000).alias(f"m{i}") for i, v in enumerate(VECTOR))))
    away = members.join(medians, "_group").select("_group", *(F.col(f"m{i}") for i in _P), *((F.col(v) - F.col(f"m{i}")).alias(f"a{i}") for i, v in enumerate(VECTOR)))
    spreads = small(away.groupBy("_group").agg(*(F.percentile_approx(F.abs(f"a{i}"), 0.5, 1000).alias(f"s{i}") for i in _P)).select("_group", *((1.4826 * F.col(f"s{i}") + FLOOR**0.5).alias(f"s{i}") for i in _P)))
    scaled = away.join(spreads, "_group").select("_group", *((F.col(f"a{i}") / F.col(f"s{i}")).alias(f"z{i}") for i in _P))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _P), F.lit(1e-12)))
    signs = scaled.select("_group", *((F.col(f"z{i}") / length).alias(f"z{i}") for i in _P)).groupBy("_group").agg(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"r{i}{j}") for i, j in _PAIRS))
    both = medians.join(spreads, "_group").join(small(signs), "_group").withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    plain = F.col("_start") == 0
    return both.select("_group", "_start", *(f"m{i}" for i in _P), *((F.when(plain, F.lit(1.0 if i == j else 0.0)).otherwise(len(VECTOR) * F.col(f"r{i}{j}")) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in _PAIRS))


def _concentrated(members: DataFrame) -> DataFrame:
    """The best estimate of each group after concentration: ``_group`` and the moments."""
    params, n = counted(_factored(_starts(members)))
    # each table of a step has a row for each of these, so the size is proven once
    sent = F.broadcast if n <= SMALL else lambda df: df
    for step in range(STEPS):
        # the determinant before the step goes along with the rows, which saves a join a step
        away = _distances(members, sent(params), ["_group", "_start", "_logdet", *VECTOR])
        bound = away.groupBy("_group", "_start").agg(F.percentile_approx("_d2", CORE, 1000).alias("_bound"))
        core = away.join(sent(bound), ["_group", "_start"]).where(F.col("_d2") <= F.col("_bound"))
        seen = Observation()
        after = _factored(_moments(core, "_group", "_start", before=F.max("_logdet"))).observe(seen, F.max(F.col("_before") - F.col("_logdet")).alias("fell"))
        params = materialize(after.drop("_before"))
        if step and (seen.get.get("fell") or 0) < 0.01:
            break
    best = params.groupBy("_group").agg(F.min(F.struct("_logdet", "_start")).alias("_best"))
    return params.join(best, "_group").where(F.col("_start") == F.col("_best._start")).select("_group", *_MOMENTS, *(c for c in params.columns if c[0] == "l"))


def _weighed(own: DataFrame, wider: DataFrame) -> DataFrame:
    """Estimates of groups drawn towards their wider level's: n rows against ``PRIOR``."""
    up = wider.select(F.col("_group").alias("_wider"), *(F.col(c).alias(f"w_{c}") for c in _MOMENTS))
    share = F.col("_n") / (F.col("_n") + PRIOR)
    return own.join(up, "_wider").select("_group", *((share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in _MOMENTS))


def outliers(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Append ``distance2`` to rows that have the vector's columns; ``by`` from the widest to the narrowest."""
    keys = [F.concat_ws("\x1f", F.lit("all"), *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?")) for c in by[:k])) for k in range(len(by) + 1)]
    own = unused(rows, "_level")
    names = [f"{own}{k}" for k in range(len(keys))]
    # the texts' statistics are written once; group tables are small, so a group that holds a third of the rows is never dealt to one task
    rows = stored(rows.withColumns(dict(zip(names, keys, strict=True))))
    members = rows.select(*VECTOR, F.explode(F.array(*names)).alias("_group"))
    found = small(_concentrated(members))
    middle = small(_distances(members, found, ["_group"]).groupBy("_group").agg(F.greatest(F.percentile_approx("_d2", 0.5, 1000) / MEDIAN, F.lit(1.0)).alias("_scale")))
    found = found.join(middle, "_group").select("_group", *(F.col(c) if c[0] == "m" else (F.col(c) * F.col("_scale")).alias(c) for c in _MOMENTS))
    sizes = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    level = small(found.where(F.col("_group") == "all"))
    for k in range(1, len(names)):
        wider = sizes.groupBy(F.col(names[k]).alias("_group"), F.col(names[k - 1]).alias("_wider")).agg(F.sum("_n").alias("_n"))
        level = small(_weighed(found.join(wider, "_group"), level))
    given = [c for c in rows.columns if c not in names]
    out = _distances(rows.withColumn("_group", F.col(names[-1])), _factored(level), given)
    return out.withColumnRenamed("_d2", "distance2")


def judge(df: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics and verdict of each row: the ``keep`` columns, the statistics, ``base_failed``, ``kept`` and ``distance2``."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = statistics(df.select(*dict.fromkeys([*keep, *by, text])), text)
    rows = rows.withColumns(vector()).withColumn("base_failed", failed())
    rows = rows.select(*dict.fromkeys([*keep, *by]), *own, "base_failed", *VECTOR)
    rows = outliers(rows, by)
    return rows.select(*keep, *own, "base_failed", (~F.col("base_failed") & (F.col("distance2") <= cutoff)).alias("kept"), "distance2")
