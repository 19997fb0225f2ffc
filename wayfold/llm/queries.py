"""The registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import op01_simhash, op02_substrings, op03_langid, op04_toxicity, op05_bpe, op06_licenses, op07_decontamination, op08_secrets, op09_quality, op10_attribution
from wayfold.llm import op11_whitening as whitening
from wayfold.llm import op12_lm as lm
from wayfold.llm import op13_search as lexical
from wayfold.llm.common import read


def _remainder(column: str, m: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % m


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op01_simhash.classes(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage of 50 words or more with another, with their class and word spans."""
    rows = op02_substrings.repeats(read(spark, sf_dir, "documents"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 5) == 0
    model = op03_langid.train(docs.where(~held_out))
    return op03_langid.predict(docs, model, extra={"held_out": held_out})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = _remainder("doc_id", 3) == 1
    marked = docs.where(~held_out).select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    model = op04_toxicity.train(marked, "toxic")
    return op04_toxicity.predict(docs, model, extra={"held_out": held_out})


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_bpe.digests(read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op06_licenses.scan(read(spark, sf_dir, "documents"))
    return rows.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["word"].cast("string"))), ","))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (document, benchmark item) that leaks, with the closest stretch."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = op07_decontamination.scan(docs, read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = op08_secrets.RULES
    base = tuple(r for r in rules if r.base)
    rows = op08_secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *(F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base),
        F.sha2(op08_secrets.listing(base), 256).alias("base_sha256"),
        op08_secrets.listing(rules).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_quality.judge(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line break belongs to the line with its first character."""
    rows = op10_attribution.attribute(read(spark, sf_dir, "documents"))
    return rows.withColumn("section_tokens", F.array_join(F.col("section_tokens").cast("array<string>"), ","))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 5) == 1
    return lm.score(docs, lm.train(docs.where(~held_out)), extra={"held_out": held_out})


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# The parts of the results that SQL can state, taken from the same operators


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_licenses.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).drop("spans")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op09_quality.statistics(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", op09_quality.failed().alias("base_failed"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_bpe.digests(read(spark, sf_dir, "documents")).select("doc_id", "decoded_sha256", (F.col("n_tokens") > 0).alias("has_tokens"))


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op10_attribution.attribute(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_sections", "n_outside", (F.aggregate("section_tokens", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("n_tokens")).alias("all_allotted"))


def embedding_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read(spark, sf_dir, "embeddings"), most=1)
    return rows.select("vec_id", "n", "deviation")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substrings": op2_substrings,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_lm_score": op12_lm_score,
    "op13_search": op13_search,
    "license_phrases": license_phrases,
    "secret_matches": secret_matches,
    "quality_statistics": quality_statistics,
    "bpe_round_trip": bpe_round_trip,
    "line_sections": line_sections,
    "embedding_deviation": embedding_deviation,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SECRET = r"""(?i:(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+))""".replace("\\'", "''")


def _matches(kind: str, number: int, pattern: str, least: int, group: int) -> str:
    """Rows of kept matches: a match begins after all pieces and matches before it."""
    return f"""select doc_id, {number} as k, '{kind}' as kind, s as start, s + length(m) as stop from (
        select doc_id, found[i] as m, length(groups[i]) as n, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) as s from (
            select *, unnest(range(1, len(found) + 1)) as i from (select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as found, regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) as groups, string_split_regex(coalesce(text, ''), '{pattern}') as pieces from documents) a) b) c where n >= {least}"""


ORACLES: dict[str, str] = {
    "license_phrases": f"""with w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
        u as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) - 1 as i from w),
        n as (select *, lead(a, 1) over x as b, lead(a, 2) over x as c, lead(a, 3) over x as d from u window x as (partition by doc_id order by i)),
        h as (select doc_id, i, case when a = 'gnu' and b = 'general' and c = 'public' and d = 'license' then 'gpl' when a = 'apache' and b = 'license' then 'apache' when a = 'cc' and b = 'by' then 'cc-by' when a = 'mit' and b = 'license' then 'mit' end as label from n)
        select w.doc_id, any_value(len(ws))::bigint as n_words, count(i) as n_base, min(i) as first_word, max(i) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
        from w left join (select * from h where label is not null) h on w.doc_id = h.doc_id group by w.doc_id""",
    "secret_matches": f"""with m as ({_matches("assign", 0, _SECRET, 6, 2)} union all {_matches("access", 1, "AKIA[A-Z0-9]+", 20, 0)} union all {_matches("hex", 2, "[0-9a-f]+", 24, 0)})
        select doc_id, count(case when k = 0 then 1 end) as n_assign, count(case when k = 1 then 1 end) as n_access, count(case when k = 2 then 1 end) as n_hex,
        sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k), '')) as base_sha256 from documents left join m using (doc_id) group by doc_id""",
    "quality_statistics": r"""with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w) x),
        r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from g) x where n > 1),
        c as (select doc_id, count(distinct i + j) as covered from r, range(8) k(j) group by doc_id),
        s as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(covered, 0)::bigint as n_repeat_words from w left join c on w.doc_id = c.doc_id)
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s""",
    "bpe_round_trip": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256, coalesce(text, '') <> '' as has_tokens from documents",
    "line_sections": "select doc_id, (len(string_split(coalesce(text, ''), chr(10))) - case when coalesce(text, '') = '' or right(text, 1) = chr(10) then 1 else 0 end)::bigint as n_sections, 0::bigint as n_outside, true as all_allotted from documents",
    "op13_search": f"""with t as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
        d as materialized (select *, len(ts)::bigint as n, row_number() over () as r from t where len(ts) > 0),
        g as materialized (select count(*)::bigint as big_n, sum(n)::bigint as big_l from d),
        f as materialized (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*)::bigint as tf from (select r, doc_id, n, unnest(ts) as term from d) x group by r, term),
        q as materialized (select distinct item_id, unnest(regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
        w as materialized (select term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, g where term in (select term from q) group by term),
        s as (select item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score from q join w using (term) join f using (term), g group by item_id, r)
        select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) x where rank <= 50""",
    "embedding_deviation": """with e as (select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint + 1000000) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        f as (select distinct x from e), g as (select unnest(x) as c, generate_subscripts(x, 1) as i from f),
        m as (select i, sum(c)::bigint as s, count(*)::bigint as n from g group by i),
        r as (select vec_id, row_number() over () as k, unnest(x) as c, generate_subscripts(x, 1) as i from e)
        select any_value(vec_id) as vec_id, any_value(n) as n, sum((n * c - s) * (n * c - s))::bigint as deviation from r join m using (i) group by k""",
}
