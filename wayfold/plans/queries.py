"""Registered queries over the derived tables, each with its oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import scores, text
from wayfold.operators import accuracy, consensus, decide, dedup, merge, queue, reports, sampling
from wayfold.plans import config
from wayfold.plans import derived as d
from wayfold.plans import enrich as plan
from wayfold.sources import requests as rq
from wayfold.sources import sinks, structurers
from wayfold.streaming import enrich as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its name, with the SQL that it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_VOTED = """calibrated as (
    select c.*, case when k.cal_low is null then greatest(0.0, least(1.0, raw_confidence))
        when raw_confidence <= raw_low then cal_low when raw_confidence >= raw_high then cal_high
        else cal_low + (raw_confidence - raw_low) / (raw_high - raw_low) * (cal_high - cal_low) end as confidence
    from cand c left join cal k on c.structurer = k.structurer and c.country = k.country and c.field = k.field),
grouped as (
    select request_id, field, trim(lower(value)) as norm, count(*) as n, min(cascade_pos) as seen from calibrated group by all),
ranked as (
    select c.*, g.n, row_number() over (partition by c.request_id, c.field order by case when g.n >= 2 then g.n else 1 end desc, case when g.n >= 2 then g.seen else 0 end, c.confidence desc, c.cascade_pos) as place,
        count(*) over (partition by c.request_id, c.field) as sources
    from calibrated c join grouped g on c.request_id = g.request_id and c.field = g.field and trim(lower(c.value)) = g.norm),
voted as (
    select request_id, field, value, case when n >= 2 then least(1.0, confidence * (1.0 + 0.1 * (n - 1))) else confidence end as confidence,
        case when n >= 2 then 'CONSENSUS' when sources = 1 then 'SINGLE_SOURCE' else 'HIGHEST_CONFIDENCE' end as merge_strategy, sources
    from ranked where place = 1)"""


def _voted(body: str) -> str:
    return d.sql("", "cc", "cand", "cal").rstrip() + ", " + _VOTED + " " + body


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.calibrate(d.candidates(spark, sf_dir), d.calibration(spark, sf_dir))


def _vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.vote(_calibrated(spark, sf_dir))


@query(_voted("select request_id, field, value, round(confidence, 9) as confidence, merge_strategy, sources from voted"))
def a1_vote(spark, sf_dir):
    return _vote(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))


@query(_voted("""select request_id, count(*) as n_fields, round(case when max(case when field = 'CTRY' then confidence end) is null or max(case when field = 'TWN_NM' then confidence end) is null then 0.0
    else least(max(case when field = 'CTRY' then confidence end), max(case when field = 'TWN_NM' then confidence end)) end, 9) as overall_confidence from voted group by request_id"""))
def a2_p6_assembled(spark, sf_dir):
    rows = merge.assemble(_vote(spark, sf_dir))
    return rows.select("request_id", F.size("fields").cast("long").alias("n_fields"), F.round(decide.overall_confidence(), 9).alias("overall_confidence"))


@query(_voted("""select conf_bucket, outcome, count(*) as n from (
    select floor(round(oc * 100) / 10) / 10 as conf_bucket, case when oc is null then 'REQUIRES_REVIEW' when oc < 0.7 then 'REQUIRES_REVIEW' else 'SUCCESS' end as outcome from (
        select request_id, case when count(case when field in ('CTRY','TWN_NM') then 1 end) = 2 then min(case when field in ('CTRY','TWN_NM') then confidence end) else 0.0 end as oc from voted group by request_id) x) y group by all"""))
def flagship(spark, sf_dir):
    """Candidates to merged addresses, outcomes and a confidence histogram."""
    rows = merge.assemble(_vote(spark, sf_dir)).withColumn("overall_confidence", decide.overall_confidence())
    tenth = F.floor(F.round(F.col("overall_confidence") * 100) / 10) / 10
    return rows.groupBy(tenth.alias("conf_bucket"), decide.outcome().alias("outcome")).agg(F.count("*").alias("n"))


_WON = "coalesce(value = max(case when place = 1 then value end) over (partition by request_id, field), false)"


@query(_voted(f"select request_id, structurer, field, {_WON} as was_selected from ranked"))
def j5_attribution(spark, sf_dir):
    cands = _calibrated(spark, sf_dir)
    return merge.attribute(cands, merge.vote(cands)).select("request_id", "structurer", "field", "was_selected")


@query(_voted(f"select request_id, country, field, structurer, value, round(raw_confidence::decimal(10,6), 6)::double as raw_confidence, cascade_pos as latency_ms, case when {_WON} then 'Y' else 'N' end as was_selected from ranked"))
def s21_attribution_rows(spark, sf_dir):
    """What the attribution table gets."""
    cands = _calibrated(spark, sf_dir).withColumn("latency_ms", F.col("cascade_pos"))
    rows = sinks.attribution_rows(merge.attribute(cands, merge.vote(cands)), F.lit(None).cast("timestamp"))
    return rows.select("request_id", "country", "field", "structurer", "value", F.col("raw_confidence").cast("double").alias("raw_confidence"), "latency_ms", "was_selected")


@query(d.sql("select c.request_id, c.structurer, c.field, round(case when k.cal_low is null then raw_confidence when raw_confidence <= raw_low then cal_low when raw_confidence >= raw_high then cal_high else cal_low + (raw_confidence - raw_low) / (raw_high - raw_low) * (cal_high - cal_low) end, 9) as confidence from cand c left join cal k on c.structurer = k.structurer and c.country = k.country and c.field = k.field", "cc", "cand", "cal"))
def j4_calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("request_id", "structurer", "field", F.round("confidence", 9).alias("confidence"))


_STRONG = "case when structurer <> 'libpostal' then true when country in ('US','GB','DE','CH') then true else false end"
_AGREED = f"""said as (select *, trim(lower(value)) as norm, {_STRONG} as strong from cand),
    agreed as (select request_id, field, count(*) as n_sources, count(distinct norm) as n_values, count(distinct case when strong then norm end) as n_strong_values,
        case when count(*) = 1 then bool_or(strong) else count(distinct norm) = 1 or count(distinct case when strong then norm end) < 2 end as agreed from said group by all)"""


@query(d.sql("", "cc", "cand").rstrip() + ", " + _AGREED + " select request_id, field, agreed, n_sources, n_values, n_strong_values from agreed")
def a3_field_consensus(spark, sf_dir):
    return consensus.by_field(d.candidates(spark, sf_dir)).select("request_id", "field", "agreed", "n_sources", "n_values", "n_strong_values")


@query(d.sql("", "cc", "cand").rstrip() + ", " + _AGREED + """ select a.request_id, a.agreements, a.disagreements, round(a.agreements / (a.agreements + a.disagreements), 9) as overall_consensus, s.source_count, a.flagged from
    (select request_id, sum(case when agreed then 1 else 0 end)::bigint as agreements, sum(case when agreed then 0 else 1 end)::bigint as disagreements, coalesce(string_agg(case when not agreed then field end, ',' order by field), '') as flagged from agreed group by all) a
    join (select request_id, count(distinct structurer) as source_count from cand group by all) s on a.request_id = s.request_id""")
def a4_request_consensus(spark, sf_dir):
    cands = d.candidates(spark, sf_dir)
    rows = consensus.by_request(consensus.by_field(cands), cands)
    return rows.select("request_id", "agreements", "disagreements", F.round("overall_consensus", 9).alias("overall_consensus"), "source_count", F.array_join("flagged_fields", ",").alias("flagged"))


@query(d.sql("select request_id, count(distinct structurer) as source_count from cand where request_id % 7 <> 0 or structurer = 'glm' group by 1 having count(distinct structurer) < 2", "cc", "cand"))
def a5_short_of_sources(spark, sf_dir):
    """Of every seventh request one source answers."""
    cands = d.candidates(spark, sf_dir).where("request_id % 7 <> 0 or structurer = 'glm'")
    return consensus.short_of_sources(consensus.by_request(consensus.by_field(cands), cands)).select("request_id", "source_count")


@query(d.sql("select country, structurer, count(*) as n from cand where country not in ('CN','AE','HK','SG') or structurer in ('glm','libpostal') group by all", "cc", "cand"))
def j3_routing(spark, sf_dir):
    routing = spark.createDataFrame([(c, ["glm", "libpostal"]) for c in config.ROUTING], "country string, structurers array<string>")
    return merge.route(d.candidates(spark, sf_dir), routing).groupBy("country", "structurer").agg(F.count("*").alias("n"))


@query(d.sql("select country, structurer, round(avg(case when structurer <> 'libpostal' then 1.0 when country in ('US','GB','DE','CH') then 1.0 else 0.3 end), 9) as weight from cand group by all", "cc", "cand"))
def j6_weights(spark, sf_dir):
    return d.candidates(spark, sf_dir).groupBy("country", "structurer").agg(F.round(F.avg(consensus.weight(F.col("structurer"), F.col("country"))), 9).alias("weight"))


# Requests


@query("select doc_id as request_id, sha256(concat(lower(regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), '|', upper(lang))) as idem_key from documents where length(text) <= 2000 and trim(text) <> ''")
def p1_p3_request_keys(spark, sf_dir):
    good, _ = rq.validate(d.requests(spark, sf_dir))
    return dedup.with_key(good).select("request_id", "idem_key")


@query("select case when length(trim(text)) = 0 then 'BLANK_ADDRESS' else 'TOO_LONG' end as reject_reason, count(*) as n from documents where length(text) > 2000 or length(trim(text)) = 0 group by all")
def p1_quarantine(spark, sf_dir):
    _, bad = rq.validate(d.requests(spark, sf_dir))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


_KEYED = "keyed as (select doc_id, concat(lower(regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), '|', upper(lang)) as k from documents where length(text) <= 2000 and trim(text) <> '')"


@query(f"with {_KEYED} select min(doc_id) as request_id from keyed group by k")
def w2_first_claims(spark, sf_dir):
    good, _ = rq.validate(d.requests(spark, sf_dir))
    return dedup.heads(dedup.with_key(good)).select("request_id")


@query(f"with {_KEYED} select min(doc_id) as request_id from keyed group by k having count(case when doc_id % 5 = 0 then 1 end) = 0")
def j7_new_claims(spark, sf_dir):
    good, _ = rq.validate(d.requests(spark, sf_dir))
    keyed = dedup.with_key(good)
    return dedup.claim(keyed, keyed.where("request_id % 5 = 0").select("idem_key")).select("request_id")


@query(f"""with {_KEYED}, known as (select k, min(doc_id) as ref from keyed where doc_id % 5 = 0 group by k)
    select doc_id as request_id, case when (ref * 37 % 101) < 50 then 'REQUIRES_REVIEW' when ref % 2 = 0 then 'SUCCESS' else 'PERSISTED_DUPLICATE' end as outcome from keyed join known using (k)""")
def j8_p10_duplicates(spark, sf_dir):
    good, _ = rq.validate(d.requests(spark, sf_dir))
    keyed = dedup.with_key(good)
    keys = keyed.where("request_id % 5 = 0").groupBy("idem_key").agg(F.min("request_id").alias("ref"))
    review = F.col("ref") * 37 % 101 < 50
    stored = keys.where(review | (F.col("ref") % 2 == 0)).select("idem_key", F.when(review, "Y").otherwise("N").alias("requires_review"))
    return dedup.resolve(keyed, keys, stored).select("request_id", decide.duplicate_outcome().alias("outcome"))


@query("""select c_custkey as request_id, 'CTRY' as field, case c_nationkey % 10 when 0 then 'US' when 1 then 'GB' when 2 then 'DE' when 3 then 'CH' when 4 then 'CN' when 5 then 'SG' when 6 then 'HK' when 7 then 'AE' when 8 then 'IR' end as value, 0.95::double as raw_confidence from customer where c_nationkey % 10 <> 9
    union all select c_custkey, 'TWN_NM', case c_custkey % 10 when 0 then 'London' when 1 then 'Berlin' when 2 then 'Zurich' when 3 then 'Dubai' when 4 then 'Singapore' when 5 then 'Geneva' when 6 then 'Munich' when 7 then 'Leeds' when 8 then 'Sharjah' else 'Tehran' end, 0.85::double from customer
    union all select c_custkey, 'STRT_NM', concat(cast(c_custkey % 97 as varchar), ' Main St'), 0.8::double from customer""")
def p18_comma_parts(spark, sf_dir):
    return structurers.comma_parts(d.addresses(spark, sf_dir)).select("request_id", "field", "value", "raw_confidence")


@query("select c_custkey as request_id, lpad(cast(c_custkey % 99999 as varchar), 5, '0') as postcode from customer where c_nationkey % 10 in (0, 2)")
def d3_rule_postcodes(spark, sf_dir):
    rows = structurers.by_rules(d.addresses(spark, sf_dir)).where("field = 'PST_CD'")
    return rows.select("request_id", F.col("value").alias("postcode")).join(d.addresses(spark, sf_dir).where("country_hint in ('US', 'DE')").select("request_id"), "request_id", "left_semi")


_TURNS = "from (select conv_id * 1000 + turn as request_id, conv_id, turn, length(text) as n from conversations) t"


@query(f"select request_id, 'TWN_NM' as field, concat('town', cast(n % 50 as varchar)) as value, (case when turn % 2 = 0 then 0.5 else 0.85 end)::double as raw_confidence {_TURNS}")
def p21_p23_model_answers(spark, sf_dir):
    """Completion envelopes with fenced or bare answers, parsed to candidates."""
    c = d.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "turn", F.length("text").alias("n"))
    town = F.concat(F.lit("town"), (F.col("n") % 50).cast("string"))
    shaped = F.to_json(F.struct(F.struct(F.struct(town.alias("value"), F.lit(0.5).alias("confidence")).alias("city")).alias("fields")))
    flat = F.concat(F.lit("```json\n"), F.to_json(F.struct(town.alias("TOWN_NAME"), F.lit("x").alias("unknown"))), F.lit("\n```"))
    content = F.when(F.col("turn") % 2 == 0, shaped).otherwise(flat)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    answers = structurers.envelope(c.select("request_id", body.alias("body")))
    return structurers.from_responses(answers, "glm").select("request_id", "field", "value", "raw_confidence")


_BATCHES = "from (select *, c_custkey // 330 * 4 + c_custkey % 330 // 110 as batch, row_number() over (partition by c_custkey // 330 * 4 + c_custkey % 330 // 110 order by c_custkey) - 1 as i, count(*) over (partition by c_custkey // 330 * 4 + c_custkey % 330 // 110) as n from customer where c_custkey % 330 % 110 < 90 or c_custkey % 330 >= 220) x"


@query(f"select concat_ws('/', cast(batch as varchar), cast(i as varchar)) as correlation_id, concat('r', cast(c_custkey as varchar)) as raw {_BATCHES} where n <= 100 union all select cast(batch as varchar), concat('refused ', cast(n as varchar)) {_BATCHES} where n > 100 and i = 0")
def s8_batch_requests(spark, sf_dir):
    """Batches of 90 and of 110 customers by key; those of 110 are refused, one row each."""
    k = F.col("c_custkey")
    c = d.table(spark, sf_dir, "customer").where((k % 330 % 110 < 90) | (k % 330 >= 220))
    item = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("rawAddress"), F.lit("").alias("countryHint"), F.lit("").alias("locale"))
    batch = (F.floor(k / 330) * 4 + F.floor(k % 330 / 110)).cast("string").alias("batch_id")
    batches = c.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    good, refused = rq.expand_batches(batches)
    return good.select("correlation_id", "raw").unionByName(refused.select(F.col("batch_id").alias("correlation_id"), F.concat(F.lit("refused "), F.col("n_items").cast("string")).alias("raw")))


@query("select concat('backfill-', cast(o_orderkey as varchar)) as correlation_id, concat(o_orderpriority, ', ', cast(o_custkey as varchar)) as raw, case when o_orderstatus = 'F' then 'DE' else '' end as country_hint from orders")
def s1_legacy_requests(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("party_id"), F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t")).alias("address_line_1"), F.lit(" ").alias("address_line_2"), F.lit(None).cast("string").alias("address_line_3"), F.col("o_custkey").cast("string").alias("address_line_4"), F.when(F.col("o_orderstatus") == "F", "DE").otherwise("DEU").alias("country_code"), F.col("o_orderdate").alias("last_updated")
    )
    return rq.from_legacy(rows).select("correlation_id", "raw", "country_hint")


# Decisions over whole plans


_FLOW = (
    d.sql("", "cc", "cand", "cal", "dict").rstrip()
    + """, routed as (select * from cand where country not in ('CN','AE','HK','SG') or structurer in ('glm','libpostal')),
    plain as (select r.*exclude(value), case when r.field <> 'CTRY' then r.value when length(trim(r.value)) <= 3 then upper(trim(r.value)) else coalesce(d.canonical, trim(r.value)) end as value
        from routed r left join dict d on d.field = 'CTRY' and r.field = 'CTRY' and d.key = lower(trim(r.value))), """
    + _VOTED.replace("from cand c left join cal k", "from plain c left join cal k")
    + """, wide as (select request_id, count(*) as n_fields, string_agg(concat(field, '=', value, '/', merge_strategy), ';' order by field) as fields, max(case when field = 'CTRY' then confidence end) as ctry, max(case when field = 'TWN_NM' then confidence end) as twn,
        max(case when field = 'STRT_NM' then confidence end) as strt, max(case when field = 'CTRY_SUB_DVSN' then confidence end) as sub, max(case when field = 'CTRY' then upper(value) end) as code from voted group by all),
    named as (select r.*exclude(country, value), case when r.country <> '' then r.country else coalesce(w.code, '') end as country, coalesce(d.canonical, trim(r.value)) as value
        from routed r left join wide w using (request_id) left join dict d on d.field = r.field and d.key = lower(trim(r.value))),
    said as (select *, trim(lower(value)) as norm, case when structurer <> 'libpostal' then true when country in ('US','GB','DE','CH') then true else false end as strong from named),
    agreed as (select request_id, field, case when count(*) = 1 then bool_or(strong) else count(distinct norm) = 1 or count(distinct case when strong then norm end) < 2 end as agreed from said group by all),
    counts as (select request_id, sum(case when agreed then 1 else 0 end)::bigint as agreements, sum(case when agreed then 0 else 1 end)::bigint as disagreements, coalesce(string_agg(case when not agreed then field end, ',' order by field), '') as flagged from agreed group by all),
    srcs as (select request_id, count(distinct structurer) as source_count from routed group by all),
    base as (select o.o_orderkey as request_id, o.country as hint, w.*exclude(request_id), c.*exclude(request_id), s.source_count, case when ctry is null or twn is null then 0.0 else least(ctry, twn) end as oc, case when o.country = 'CN' then 0.65 else 0.7 end as lim
        from cc o left join wide w on w.request_id = o.o_orderkey left join counts c on c.request_id = o.o_orderkey left join srcs s on s.request_id = o.o_orderkey),
    ruled as (select *, concat_ws(',', case when oc < 0.7 then 'low-confidence' end, case when ctry is null or twn is null then 'missing-mandatory' end, case when disagreements >= 2 then 'consensus-disagreement' end, case when source_count is null or source_count < 2 then 'single-source' end,
        case when hint = 'IR' then 'high-risk-country' end, case when ctry < 0.5 or twn < 0.5 or strt < 0.5 then 'field-confidence-floor' end) as rules,
        case when n_fields is null then 'UNSTRUCTURABLE' when ctry is null or twn is null or oc < lim then 'REQUIRES_REVIEW' else 'SUCCESS' end as first_outcome,
        case when n_fields is null then 'UNSTRUCTURABLE' when ctry is null or twn is null then 'MISSING_REQUIRED' when oc < lim then 'LOW_CONFIDENCE' end as exception_reason from base),
    axes as (select *, case when n_fields is null then 'UNSTRUCTURABLE' else concat_ws(',', case when ctry is null or ctry < 0.95 or twn is null or twn < 0.8 or sub is null or sub < 0.75 then 'LOW_FIELD_CONFIDENCE' end, case when oc < 0.85 then 'LOW_OVERALL_CONFIDENCE' end,
        case when coalesce(code, hint) = 'IR' then 'HIGH_RISK_COUNTRY' end, case when request_id % 50 = 0 then 'SANCTIONS_PATTERN_MATCH' end, case when ctry is null or twn is null then 'SCHEMA_INCOMPLETE' end) end as reasons from ruled)
    select request_id, coalesce(fields, '') as fields, round(oc, 9) as overall_confidence, agreements, disagreements, source_count, flagged, first_outcome, exception_reason, rules,
        case when first_outcome = 'SUCCESS' and rules <> '' then 'REQUIRES_REVIEW' else first_outcome end as outcome, case when rules = '' then 'AutoApproved' else 'ManualReview' end as recommendation,
        reasons, case when reasons = '' then 'BYPASS' else 'ROUTE' end as decision, case when reasons = '' then 'NONE' when n_fields is null then 'BLOCKING' when contains(reasons, 'SANCTIONS') or contains(reasons, 'HIGH_RISK') then 'EXPEDITED' else 'STANDARD' end as urgency from axes"""
)


@query(_FLOW)
def enrich_flow(spark, sf_dir):
    """The whole plan: routing, country normalisation, calibration, vote, consensus on normalised values, review and compliance."""
    routes = spark.createDataFrame([(c, ["glm", "libpostal"]) for c in config.ROUTING], "country string, structurers array<string>")
    found = d.candidates(spark, sf_dir).drop("country")
    rows = plan.enrich(d.order_requests(spark, sf_dir), found, d.dictionary(spark, sf_dir), d.calibration(spark, sf_dir), routes, config=config.COMPLIANCE | {"shadow": False})
    said = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("/"), e["value"]["merge_strategy"])))
    return rows.select(
        "request_id", F.coalesce(F.array_join(said, ";"), F.lit("")).alias("fields"), F.round("overall_confidence", 9).alias("overall_confidence"), "agreements", "disagreements", "source_count", F.array_join("flagged_fields", ",").alias("flagged"),
        "first_outcome", "exception_reason", F.array_join(F.transform("review_reasons", lambda r: r["rule"]), ",").alias("rules"), "outcome", "recommendation", F.array_join("reasons", ",").alias("reasons"), "decision", F.coalesce("urgency", F.lit("NONE")).alias("urgency"),
    )


def _decided(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    rows = plan.assembled(_calibrated(spark, sf_dir).withColumn("full", F.col("value"))).withColumnRenamed("country", "country_hint")
    rows = rows.withColumn("raw", F.concat(F.lit("order "), F.when(F.col("request_id") % 50 == 0, "Bank  Melli").otherwise("house")))
    return plan.decided(rows.withColumn("overall_confidence", decide.overall_confidence()), **settings)


_DECIDED = (
    d.sql("", "cc", "cand", "cal").rstrip()
    + ", "
    + _VOTED
    + ", "
    + _AGREED
    + """, wide as (select request_id, max(case when field = 'CTRY' then confidence end) as ctry, max(case when field = 'TWN_NM' then confidence end) as twn, max(case when field = 'STRT_NM' then confidence end) as strt, max(case when field = 'CTRY_SUB_DVSN' then confidence end) as sub, max(case when field = 'CTRY' then upper(value) end) as code from voted group by all),
    counts as (select request_id, sum(case when agreed then 0 else 1 end) as dis from agreed group by all),
    srcs as (select request_id, min(country) as hint, count(distinct structurer) as n from cand group by all),
    base as (select s.request_id, s.hint, s.n, c.dis, w.*exclude(request_id), case when ctry is null or twn is null then 0.0 else least(ctry, twn) end as oc, case when s.hint = 'CN' then 0.65 else 0.7 end as lim from srcs s left join wide w using (request_id) left join counts c using (request_id)),
    ruled as (select *, concat_ws(',', case when oc < 0.7 then 'low-confidence' end, case when ctry is null or twn is null then 'missing-mandatory' end, case when dis >= 2 then 'consensus-disagreement' end, case when n < 2 then 'single-source' end, case when hint in ('IR') then 'high-risk-country' end, case when ctry < 0.5 or twn < 0.5 or strt < 0.5 then 'field-confidence-floor' end) as rules,
        case when ctry is null or twn is null or oc < lim then 'REQUIRES_REVIEW' else 'SUCCESS' end as first_outcome from base)"""
)


@query(_DECIDED + " select request_id, rules, first_outcome, case when rules <> '' then 'REQUIRES_REVIEW' else first_outcome end as outcome, case when rules = '' then 'AutoApproved' else 'ManualReview' end as recommendation from ruled")
def r1_r7_review(spark, sf_dir):
    rows = _decided(spark, sf_dir)
    return rows.select("request_id", F.array_join(F.transform("review_reasons", lambda r: r["rule"]), ",").alias("rules"), "first_outcome", "outcome", "recommendation")


@query(_DECIDED + """, axes as (select *, concat_ws(',', case when ctry is null or ctry < 0.95 or twn is null or twn < 0.8 or sub is null or sub < 0.75 then 'LOW_FIELD_CONFIDENCE' end, case when oc < 0.85 then 'LOW_OVERALL_CONFIDENCE' end,
    case when coalesce(code, hint) in ('IR') then 'HIGH_RISK_COUNTRY' end, case when request_id % 50 = 0 then 'SANCTIONS_PATTERN_MATCH' end, case when ctry is null or twn is null then 'SCHEMA_INCOMPLETE' end) as reasons from ruled)
    select request_id, reasons, case when reasons = '' then 'BYPASS' else 'ROUTE' end as would_decision, case when reasons = '' then 'BYPASS' else 'ROUTE' end as decision, case when reasons = '' then 'NONE' when contains(reasons, 'SANCTIONS') or contains(reasons, 'HIGH_RISK') then 'EXPEDITED' else 'STANDARD' end as urgency from axes""")
def o1_o6_compliance(spark, sf_dir):
    rows = _decided(spark, sf_dir, config=config.COMPLIANCE | {"shadow": False})
    return rows.select("request_id", F.array_join("reasons", ",").alias("reasons"), "would_decision", "decision", F.coalesce("urgency", F.lit("NONE")).alias("urgency"))


@query(_DECIDED + " select cast(request_id as varchar) as correlation_id, hint as country, case when ctry is null or twn is null then 'MISSING_REQUIRED' else 'LOW_CONFIDENCE' end as reason, 'OPEN' as status, 1 as version from ruled where ctry is null or twn is null or oc < lim")
def s20_p7_exceptions(spark, sf_dir):
    rows = _decided(spark, sf_dir).withColumns({"idem_key": F.col("request_id").cast("string"), "correlation_id": F.col("request_id").cast("string")})
    return sinks.exception_rows(rows, F.lit(None).cast("timestamp")).select("correlation_id", "country", "reason", "status", "version")


@query(_voted("select request_id, field, value, merge_strategy, round(confidence, 9) as confidence from voted"))
def s18_s19_stored_fields(spark, sf_dir):
    """Fields written as JSON and read back."""
    rows = merge.assemble(_vote(spark, sf_dir)).select("request_id", F.to_json("fields").alias("fields_json"))
    each = sinks.decode(rows, config.FIELDS).select("request_id", F.explode("fields").alias("field", "v"))
    return each.select("request_id", "field", "v.value", "v.merge_strategy", F.round("v.confidence", 9).alias("confidence"))


@query("""with x as (select o_orderkey as request_id, o.o_custkey, case c.c_nationkey % 10 when 0 then 'US' when 1 then 'GB' when 2 then 'DE' when 3 then 'CH' when 4 then 'CN' when 5 then 'SG' when 6 then 'HK' when 7 then 'AE' when 8 then 'IR' else '' end as country,
        case when o_orderkey % 4 = 0 then null else lpad(cast(o_custkey % 100000 as varchar), 5, '0') end as pc, case when o_orderkey % 5 = 0 then 'USA' else 'US' end as ctry, o_orderkey % 7 <> 0 as town from orders o join customer c on o.o_custkey = c.c_custkey)
    select request_id, 'PST_CD' as field, 'WARNING' as severity from x where pc is not null and country in ('GB','CH','SG','CN')
        union all select request_id, 'PST_CD', 'INFO' from x where pc is null and country not in ('HK','AE','')
        union all select request_id, 'PST_CD', 'WARNING' from x where pc is not null and country in ('HK','AE')
        union all select request_id, 'CTRY', 'ERROR' from x where ctry = 'USA' and country <> ''
        union all select request_id, 'TWN_NM', 'ERROR' from x where not town and country <> ''""")
def v1_v4_format(spark, sf_dir):
    o = d.orders(spark, sf_dir)
    k = F.col("o_orderkey")
    given = {"CTRY": F.when(k % 5 == 0, "USA").otherwise("US"), "PST_CD": F.when(k % 4 != 0, F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")), "TWN_NM": F.when(k % 7 != 0, "Town")}
    entries = F.array(*(F.struct(F.lit(f).alias("key"), F.struct(v.alias("value"), F.lit(0.9).alias("confidence"), F.lit("SINGLE_SOURCE").alias("merge_strategy")).alias("value")) for f, v in given.items()))
    rows = o.select(k.alias("request_id"), "country", F.map_from_entries(F.filter(entries, lambda e: e["value"]["value"].isNotNull())).alias("fields"))
    return decide.issues_table(rows).select("request_id", "field", "severity")


# Reports


def _report(f, source, ts):
    def run(spark, sf_dir):
        rows = source(spark, sf_dir)
        return f(rows, reports.latest(rows, ts))

    return run


@query(d.sql("select country, field, count(*) as samples_reviewed, sum(ok)::bigint as correct, round(avg(ok), 3) as accuracy from verdicts where reviewed_at > (select max(reviewed_at) from verdicts) - interval 30 day group by all", "cc", "verdicts"))
def a8_daily_accuracy(spark, sf_dir):
    return _report(reports.daily_accuracy, d.samples, "reviewed_at")(spark, sf_dir)


@query(d.sql("select country, field, structurer, count(*) as times_selected, round(sum(c100) / 100 / count(*) + 1e-9, 3) as avg_calibrated_conf, round(avg(latency_ms), 0) as avg_latency_ms from attr where was_selected = 'Y' and created_at > (select max(created_at) from attr) - interval 7 day group by all", "attr"))
def a9_contribution(spark, sf_dir):
    return _report(reports.contribution, d.attributions, "created_at")(spark, sf_dir)


@query(d.sql("select country, (floor(overall_confidence * 10) / 10)::double as conf_bucket, count(*) as n from results where created_at > (select max(created_at) from results) - interval 7 day group by all", "cc", "results"))
def a10_confidence_histogram(spark, sf_dir):
    return _report(reports.confidence_histogram, d.results, "created_at")(spark, sf_dir).withColumn("conf_bucket", F.col("conf_bucket").cast("double"))


@query(d.sql("select country, field, count(distinct result_id) as results_reviewed, count(*) as total_corrections, round(count(*) / nullif(count(distinct result_id), 0), 3) as corrections_per_review from feedback where corrected_at > (select max(corrected_at) from feedback) - interval 14 day group by all", "feedback"))
def a11_correction_rate(spark, sf_dir):
    return _report(reports.correction_rate, d.feedback, "corrected_at")(spark, sf_dir)


@query(d.sql("""select strftime(date_trunc('week', reviewed_at), '%Y-%m-%d') as week_starting, country, count(distinct result_id) as samples, round(avg(case when field = 'CTRY' then ok end), 3) as ctry_acc, round(avg(case when field = 'TWN_NM' then ok end), 3) as twn_nm_acc,
    round(avg(case when field = 'STRT_NM' then ok end), 3) as strt_nm_acc, round(avg(case when field = 'PST_CD' then ok end), 3) as pst_cd_acc from verdicts where reviewed_at > (select max(reviewed_at) from verdicts) - interval 84 day group by all""", "cc", "verdicts"))
def a12_weekly_accuracy(spark, sf_dir):
    return _report(reports.weekly_accuracy, d.samples, "reviewed_at")(spark, sf_dir).withColumn("week_starting", F.col("week_starting").cast("string"))


@query(d.sql("select strftime(created_at, '%Y-%m-%d') as date, country, count(*) as total_processed, sum(case when requires_review = 'Y' then 1 else 0 end)::bigint as sent_to_exception, round(avg(case when requires_review = 'Y' then 1.0 else 0.0 end), 3) as exception_rate from results where created_at > (select max(created_at) from results) - interval 14 day group by all", "cc", "results"))
def a13_exception_rate(spark, sf_dir):
    return _report(reports.exception_rate, d.results, "created_at")(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query(d.sql("""select country, decision, primary_reason, count(*) as routings, round(avg(case when compliance_verdict = 'PASS' then 1.0 else 0.0 end), 3) as pass_rate, round(avg(case when compliance_verdict = 'REJECT' then 1.0 else 0.0 end), 3) as reject_rate,
    round(avg(case when compliance_verdict = 'NEEDS_REVIEW' then 1.0 else 0.0 end), 3) as needs_review_rate, round(avg(latency::double), 1) as avg_latency_sec from routing where status = 'RESOLVED' and created_at > (select max(created_at) from routing) - interval 7 day group by all""", "routing"))
def a14_compliance_routing(spark, sf_dir):
    return _report(reports.compliance_routing, d.routing, "created_at")(spark, sf_dir)


@query(d.sql("select country, decision, count(*) as routings, round(avg(case when compliance_verdict = 'PASS' then 1.0 else 0.0 end), 3) as pass_rate from routing where status = 'RESOLVED' and created_at > (select max(created_at) from routing) - interval 7 day group by all", "routing"))
def a19_compliance_short(spark, sf_dir):
    return _report(reports.compliance_short, d.routing, "created_at")(spark, sf_dir)


@query(d.sql("select structurer, count(*) as times_selected from attr where was_selected = 'Y' and field = 'CTRY' and country = 'US' and created_at > (select max(created_at) from attr) - interval 70 day group by all", "attr"))
def a18_winning_structurer(spark, sf_dir):
    rows = d.attributions(spark, sf_dir)
    return reports.winners(rows, reports.latest(rows, "created_at") - F.expr("interval 0 days") - F.expr("interval 63 days"), "CTRY", "US").select("structurer", "times_selected")


@query(d.sql("select structurer, field, country, count(*) as n, sum(c100)::double as total, sum(case when c100 < 10 then 1 else 0 end)::bigint as b0, sum(case when c100 >= 50 and c100 < 60 then 1 else 0 end)::bigint as b5, sum(case when c100 = 100 then 1 else 0 end)::bigint as b10, sum(case when raw_confidence = c100::double / 100 then 1 else 0 end)::bigint as fallbacks from attr group by all", "attr"))
def d14_distribution(spark, sf_dir):
    return reports.distribution(d.attributions(spark, sf_dir)).withColumn("total", F.round(F.col("mean") * F.col("n") * 100)).drop("mean")


@query(d.sql("""select country, week_starting, round(accuracy, 6) as accuracy, round(previous, 6) as previous, coalesce(previous - accuracy > 0.05, false) as dropped, previous is not null and greatest(accuracy, previous) < 0.8 as low_for_two_weeks from (
    select *, lag(accuracy) over (partition by country order by week_starting) as previous from (select country, strftime(date_trunc('week', reviewed_at), '%Y-%m-%d') as week_starting, avg(ok) as accuracy from verdicts group by all) w) x""", "cc", "verdicts"))
def w5_week_triggers(spark, sf_dir):
    each = d.samples(spark, sf_dir).select("country", F.date_trunc("week", "reviewed_at").cast("date").cast("string").alias("week_starting"), F.explode(F.from_json("per_field_verdict", reports.VERDICTS)).alias("field", "v"))
    weekly = each.groupBy("country", "week_starting").agg(F.avg(F.when(F.col("v.verdict") == "correct", 1.0).otherwise(0.0)).alias("accuracy"))
    return reports.week_triggers(weekly).withColumns({"accuracy": F.round("accuracy", 6), "previous": F.round("previous", 6)})


@query(d.sql("select country, sum(case when reviewed_at > (select max(reviewed_at) from verdicts) - interval 30 day then 1 else 0 end)::bigint as reviewed from verdicts where field = 'CTRY' group by all having sum(case when reviewed_at > (select max(reviewed_at) from verdicts) - interval 30 day then 1 else 0 end) < 30", "cc", "verdicts"))
def d10_stale_reviewers(spark, sf_dir):
    return _report(reports.stale_reviewers, d.samples, "reviewed_at")(spark, sf_dir)


@query("select case role when 'user' then 'glm' else 'azure-gpt' end as structurer, role as model, count(*) as calls, sum(length(text))::bigint as input_tokens, sum(length(text) % 100)::bigint as output_tokens, round(avg((turn * 10)::double), 3) as avg_latency_ms, max(turn * 10) as max_latency_ms from conversations group by all")
def d16_usage(spark, sf_dir):
    c = d.table(spark, sf_dir, "conversations")
    calls = c.select(F.when(F.col("role") == "user", "glm").otherwise("azure-gpt").alias("structurer"), F.col("role").alias("model"), F.length("text").cast("long").alias("input_tokens"), (F.length("text") % 100).cast("long").alias("output_tokens"), (F.col("turn") * 10).alias("latency_ms"))
    return reports.usage(calls)


@query(d.sql("select country as source_channel, requires_review as outcome, count(*) as processed, sum(case when result_id % 9 = 0 then 1 else 0 end)::bigint as duplicates, count(case when requires_review = 'Y' then 1 end) as exceptions, round(avg(latency_ms::double), 3) as avg_latency_ms, max(latency_ms) as max_latency_ms from results group by all", "cc", "results"))
def a6_a7_metrics(spark, sf_dir):
    rows = d.results(spark, sf_dir).select(F.col("country").alias("source_channel"), F.col("requires_review").alias("outcome"), (F.col("result_id") % 9 == 0).alias("is_duplicate"), F.when(F.col("requires_review") == "Y", "LOW_CONFIDENCE").alias("exception_reason"), "latency_ms")
    return reports.metrics(rows)


@query(d.sql("select structurer, country, count(*) as calls, round(avg(latency_ms::double), 3) as avg_latency_ms, max(latency_ms)::double as max_latency_ms from attr group by all", "attr"))
def a7_latency_by_source(spark, sf_dir):
    return reports.latencies(d.attributions(spark, sf_dir), "structurer", "country").withColumn("max_latency_ms", F.col("max_latency_ms").cast("double"))


@query(d.sql("select country, case when overall_confidence < 0.35 then 'MISSING_REQUIRED' else 'LOW_CONFIDENCE' end as exception_reason, count(*) as n from results where requires_review = 'Y' group by all", "cc", "results"))
def a7_exceptions_by_reason(spark, sf_dir):
    rows = d.results(spark, sf_dir).withColumn("exception_reason", F.when(F.col("requires_review") == "Y", F.when(F.col("overall_confidence") < 0.35, "MISSING_REQUIRED").otherwise("LOW_CONFIDENCE")))
    return reports.exceptions(rows)


@query(d.sql("select case when result_id % 9 = 0 then 'PERSISTED_DUPLICATE' when requires_review = 'Y' then 'REQUIRES_REVIEW' else 'SUCCESS' end as outcome, count(*) as n, result_id % 9 = 0 or requires_review = 'N' as successful from results group by all", "cc", "results"))
def a6_p11_tallies(spark, sf_dir):
    """Backfill tallies, and whether an outcome counts as success."""
    rows = d.results(spark, sf_dir).select(F.when(F.col("result_id") % 9 == 0, "PERSISTED_DUPLICATE").when(F.col("requires_review") == "Y", "REQUIRES_REVIEW").otherwise("SUCCESS").alias("outcome"))
    return reports.tallies(rows).withColumn("successful", decide.is_success())


# Queue, samples, golden scores


@query(d.sql("""select result_id as item_id, case when place <= 100 then 'CLAIMED' else 'OPEN' end as status, case when place <= 100 then 2 else 1 end as version, case when place <= 100 then 'ann' end as assigned_to from (
        select result_id, row_number() over (order by created_at, result_id) as place from results where requires_review = 'Y') x""", "cc", "results"))
def t2_claim(spark, sf_dir):
    """The hundred oldest open items are taken; the number is the feature."""
    return queue.claim(_queue(spark, sf_dir), 100, "ann").select("item_id", "status", "version", "assigned_to")


def _queue(spark, sf_dir):
    return d.results(spark, sf_dir).where("requires_review = 'Y'").select(F.col("result_id").alias("item_id"), "country", "created_at", F.lit("OPEN").alias("status"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("string").alias("resolution"))


@query(d.sql("""select result_id as item_id, case when result_id % 3 = 0 and result_id % 2 = 0 and result_id % 5 <> 0 then 'resolved' when result_id % 2 = 0 then 'clash' else 'untouched' end as kind,
    case when result_id % 5 = 0 then 3 else 2 end + case when result_id % 3 = 0 and result_id % 2 = 0 and result_id % 5 <> 0 then 1 else 0 end as version from results where requires_review = 'Y'""", "cc", "results"))
def t3_resolve(spark, sf_dir):
    """Every second item is resolved; those not claimed (two of three) or of another version (every fifth) clash."""
    taken = _queue(spark, sf_dir).withColumn("status", F.when(F.col("item_id") % 3 == 0, "CLAIMED").otherwise("OPEN")).withColumn("version", F.when(F.col("item_id") % 5 == 0, 3).otherwise(2))
    wanted = taken.where("item_id % 2 = 0").select("item_id", F.lit(2).alias("expected_version"), F.lit("APPROVED").alias("resolution"))
    after, clashes = queue.resolve(taken, wanted)
    return after.join(clashes.select("item_id", F.lit(True).alias("clash")), "item_id", "left").select("item_id", F.when(F.col("status") == "RESOLVED", "resolved").when(F.col("clash"), "clash").otherwise("untouched").alias("kind"), "version")


_DRAW = "row_number() over (partition by {} order by sha256(concat(cast(result_id as varchar), '/0')), result_id)"


@query(d.sql(f"""select result_id, country, bucket as confidence_bucket from (select *, {_DRAW.format('country, bucket')} as place from (
    select result_id, country, case when overall_confidence >= 0.9 then 'HIGH' when overall_confidence >= 0.7 then 'MID' else 'LOW' end as bucket from results where country in ('AE','SG','HK','CN','GB','US','DE','CH') and created_at >= (select max(created_at) from results) - interval 1 day) x) y where place <= case bucket when 'LOW' then 2 else 4 end""", "cc", "results"))
def w3_review_sample(spark, sf_dir):
    rows = d.results(spark, sf_dir)
    return sampling.for_review(rows, reports.latest(rows, "created_at")).select("result_id", "country", "confidence_bucket")


@query(d.sql(f"select result_id, country from (select *, {_DRAW.format('country')} as place from results) x where place <= 100", "cc", "results"))
def w4_country_sample(spark, sf_dir):
    return sampling.per_country(d.results(spark, sf_dir), 100, "result_id").select("result_id", "country")


def _golden(spark, sf_dir):
    won = _vote(spark, sf_dir).select(F.col("request_id").alias("fixture_id"), "field", "value")
    country = d.orders(spark, sf_dir).select(F.col("o_orderkey").alias("fixture_id"), "country", "o_custkey")
    expected = F.concat(F.lit("VAL"), ((F.col("o_custkey") + F.col("f") * 5) % 50).cast("string"))
    gold = country.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("f")).select("fixture_id", "country", d._pick(d.FIELD_OF, F.col("f")).alias("field"), F.when(F.col("fixture_id") % 6 == 0, "").otherwise(expected).alias("expected"))
    return gold, won, country


_GOLD = """gold as (select o_orderkey as fixture_id, country, f.n as field, case when o_orderkey % 6 = 0 then '' else concat('VAL', cast((o_custkey + f.i*5) % 50 as varchar)) end as expected from cc, (values (0,'CTRY'),(1,'TWN_NM'),(2,'PST_CD'),(3,'CTRY_SUB_DVSN'),(4,'STRT_NM'),(5,'BLDG_NB'),(6,'BLDG_NM')) f(i, n)),
    compared as (select g.*, v.value as actual, coalesce(lower(v.value) = lower(g.expected), false) as matched from gold g left join voted v on g.fixture_id = v.request_id and g.field = v.field where g.expected <> '')"""


@query(_voted("").rstrip() + ", " + _GOLD + """, scored as (select cc.o_orderkey as fixture_id, cc.country, coalesce(m.hit * 1.0 / m.n, -1.0) as accuracy from cc left join (select fixture_id, count(*) as n, sum(case when matched then 1 else 0 end) as hit from compared group by all) m on cc.o_orderkey = m.fixture_id)
    select country, count(*) as total, round(avg(case when accuracy >= 0 then accuracy end), 6) as mean_accuracy, sum(case when accuracy = 1 then 1 else 0 end)::bigint as perfect from scored group by grouping sets ((country), ())""")
def a15_a17_golden(spark, sf_dir):
    gold, won, country = _golden(spark, sf_dir)
    scored = accuracy.by_fixture(accuracy.compare(gold, won), country.select("fixture_id", "country"))
    rows = scored.withColumns({"latency_ms": F.lit(0), "outcome": F.lit(""), "disagreements": F.lit(0)})
    return accuracy.summary(rows).select("country", "total", "mean_accuracy", "perfect")


@query(_voted("").rstrip() + ", " + _GOLD + """ select country, field, round(sum(case when lower(expected) = lower(actual) then 1 else 0 end) / nullif(count(actual), 0), 6) as precision, round(sum(case when lower(expected) = lower(actual) then 1 else 0 end) / nullif(count(expected), 0), 6) as recall from (
    select cc.country, coalesce(g.field, v.field) as field, g.expected, v.value as actual from (select * from gold where expected <> '') g full join (select * from voted where trim(value) <> '') v on g.fixture_id = v.request_id and g.field = v.field join cc on cc.o_orderkey = coalesce(g.fixture_id, v.request_id)) x group by all""")
def d12_precision_recall(spark, sf_dir):
    gold, won, _ = _golden(spark, sf_dir)
    return accuracy.precision_recall(gold, won)


@query("select case user_id % 3 when 0 then 'HTTP' when 1 then 'KAFKA' else 'RABBITMQ' end as source_channel, event_type as outcome, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as processed, round(avg(event_id % 100), 6) as avg_latency_ms from events group by all")
def k9_live_metrics(spark, sf_dir):
    """The streaming aggregation as a table."""
    e = d.table(spark, sf_dir, "events").select("ts", F.when(F.col("user_id") % 3 == 0, "HTTP").when(F.col("user_id") % 3 == 1, "KAFKA").otherwise("RABBITMQ").alias("source_channel"), F.col("event_type").alias("outcome"), (F.col("event_id") % 100).alias("latency_ms"))
    return stream.live_metrics(e).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("select event_id, round(case when value <= 10 then 0.1 when value >= 90 then 0.9 else 0.1 + (value - 10) / 80 * 0.8 end, 9) as confidence from events")
def f_interpolation(spark, sf_dir):
    lit = [F.lit(x) for x in (10.0, 90.0, 0.1, 0.9)]
    return d.table(spark, sf_dir, "events").select("event_id", F.round(scores.interpolate(F.col("value"), *lit), 9).alias("confidence"))


@query("select doc_id, sha256(lower(regexp_replace(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) as canonical from documents")
def p2_canonical(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.canonical(F.col("text")), 256).alias("canonical"))
