"""Logical tables derived from the given ones by expressions that any SQL engine can repeat.

The given tables hold no addresses, so countries, fields, confidences and
verdicts come from key arithmetic; documents serve as raw texts. ``SQL`` has
the same derivations as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("US", "GB", "DE", "CH", "CN", "SG", "HK", "AE", "IR", "")
FIELD_OF = ("CTRY", "TWN_NM", "PST_CD", "CTRY_SUB_DVSN", "STRT_NM", "BLDG_NB", "BLDG_NM")
SOURCES = ("libpostal", "glm", "azure-gpt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _country(nation: Column) -> Column:
    return _pick(COUNTRIES, nation % 10)


def _case(values: tuple[str, ...], index: str) -> str:
    return f"case {index} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the country of their customer. Customers and their join stay with Catalyst."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), _country(F.col("c_nationkey")).alias("country"))
    return table(spark, sf_dir, "orders").join(customer, "o_custkey")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sources and seven fields a request, with case, space and value variants."""
    o, s, f = F.col("o_orderkey"), F.col("s"), F.col("f")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "country", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("f"))
    rows = rows.where((o * 31 + s * s * 17 + f * 13) % 10 < 6)
    v = F.concat(F.lit("val"), ((F.col("o_custkey") + f * 5 + F.when((o + s * 3 + f) % 4 == 0, s + 1).otherwise(0)) % 50).cast("string"))
    return rows.select(
        o.alias("request_id"),
        "country",
        _pick(SOURCES, s).alias("structurer"),
        s.alias("cascade_pos"),
        _pick(FIELD_OF, f).alias("field"),
        F.when(s == 1, F.upper(v)).when(s == 2, F.concat(v, F.lit(" "))).otherwise(v).alias("value"),
        (((o * 37 + s * 11 + f * 5) % 101).cast("double") / 100).alias("raw_confidence"),
    )


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for every third (source, country, field), by arithmetic over nations."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").alias("n"))
    rows = nation.select("n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("f")).where((F.col("n") + F.col("s") + F.col("f")) % 3 == 0)
    return rows.select(_pick(SOURCES, F.col("s")).alias("structurer"), _country(F.col("n")).alias("country"), _pick(FIELD_OF, F.col("f")).alias("field"), F.lit(0.2).alias("raw_low"), F.lit(0.8).alias("raw_high"), F.lit(0.1).alias("cal_low"), ((90 - F.col("n")).cast("double") / 100).alias("cal_high"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms of the first twenty-five values of four fields, by arithmetic over nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), "n_name")
    country = F.when(F.col("n") < 9, _country(F.col("n"))).otherwise(F.col("n_name"))
    forms = {"CTRY": country, "CTRY_SUB_DVSN": F.concat(F.lit("Region "), F.col("n").cast("string")), "STRT_NM": F.concat(F.lit("Street "), (F.col("n") % 5).cast("string")), "BLDG_NM": F.lit("House")}
    return n.select(F.concat(F.lit("val"), F.col("n").cast("string")).alias("key"), F.explode(F.map_from_arrays(F.array(*map(F.lit, forms)), F.array(*forms.values()))).alias("field", "canonical")).select("field", "key", "canonical")


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address request an order; some name a watched bank."""
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).select(k.alias("request_id"), F.col("country").alias("country_hint"), F.concat(F.lit("order "), F.when(k % 50 == 0, "Bank  Melli").otherwise("house")).alias("raw"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ((F.col("o_orderkey") * 37 % 101).cast("decimal(5,2)") / 100).cast("decimal(3,2)")
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("result_id"), "country", c.alias("overall_confidence"), F.when(c < 0.70, "Y").otherwise("N").alias("requires_review"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 7).alias("latency_ms"))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 101).cast("double") / 100
    calibrated = (((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 101 * (F.col("l_partkey") % 2 + 1) % 101).cast("decimal(5,2)") / 100).cast("decimal(3,2)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("result_id"), _country(F.col("l_suppkey")).alias("country"), _pick(FIELD_OF, F.col("l_partkey") % 7).alias("field"), _pick(SOURCES, F.col("l_linenumber") % 3).alias("structurer"), raw.alias("raw_confidence"), calibrated.alias("calibrated_confidence"), F.col("l_quantity").alias("latency_ms"), F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("was_selected"), F.col("l_shipdate").alias("created_at")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.select(F.col("l_orderkey").alias("result_id"), _country(F.col("l_suppkey")).alias("country"), _pick(FIELD_OF, F.col("l_partkey") % 7).alias("field"), F.col("l_shipdate").alias("corrected_at"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on four fields as JSON; every fifth is wrong in one of them."""
    k = F.col("o_orderkey")
    said = [F.concat(F.lit(f'"{f}":{{"verdict":"'), F.when((k + i) % 5 == 0, "wrong").otherwise("correct"), F.lit('"}')) for i, f in enumerate(("CTRY", "TWN_NM", "STRT_NM", "PST_CD"))]
    return orders(spark, sf_dir).where("o_orderstatus = 'F'").select(k.alias("result_id"), "country", F.lit("REVIEWED").alias("status"), F.col("o_orderdate").alias("reviewed_at"), F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}")).alias("per_field_verdict"))


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u, t = F.col("user_id"), F.col("event_type")
    return e.select(
        "event_id",
        _country(u).alias("country"),
        F.when(t == "error", "BLOCK").when(t.isin("purchase", "signup"), "ROUTE").otherwise("BYPASS").alias("decision"),
        F.when(t == "error", "SANCTIONS_PATTERN_MATCH").when(u % 2 == 0, "LOW_OVERALL_CONFIDENCE").otherwise("LOW_FIELD_CONFIDENCE").alias("primary_reason"),
        F.when(u % 3 == 0, "PASS").when(u % 3 == 1, "REJECT").otherwise("NEEDS_REVIEW").alias("compliance_verdict"),
        F.when(u % 10 < 9, "RESOLVED").otherwise("PENDING").alias("status"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("routed_at"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 9000) * 1000000).alias("responded_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw texts: repeats, long texts and four languages come with them."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"), F.when(F.col("doc_id") % 3 == 0, "HTTP").when(F.col("doc_id") % 3 == 1, "KAFKA").otherwise("RABBITMQ").alias("source_channel"), F.col("text").alias("raw"), F.col("lang").alias("country_hint"), F.lit("").alias("locale"), F.col("doc_id").alias("arrival_ts")
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address-like texts of customers, with a country hint."""
    c = F.col("c_custkey")
    towns = ("London", "Berlin", "Zurich", "Dubai", "Singapore", "Geneva", "Munich", "Leeds", "Sharjah", "Tehran")
    text = F.concat(_pick(towns, c % 10), F.lit(", "), (c % 97).cast("string"), F.lit(" Main St, "), F.lpad((c % 99999).cast("string"), 5, "0"))
    return table(spark, sf_dir, "customer").select(c.alias("request_id"), text.alias("raw"), _country(F.col("c_nationkey")).alias("country_hint"))


SQL = {
    "cc": f"cc as (select o.*, {_case(COUNTRIES, 'c.c_nationkey % 10')} as country from orders o join customer c on o.o_custkey = c.c_custkey)",
    "cand": f"""cand as (select o_orderkey as request_id, country, {_case(SOURCES, 's')} as structurer, s as cascade_pos, {_case(FIELD_OF, 'f')} as field,
        case s when 1 then upper(v) when 2 then concat(v, ' ') else v end as value, cast((o_orderkey*37 + s*11 + f*5) % 101 as double)/100 as raw_confidence
        from (select cc.*, s.s, f.f, concat('val', cast((o_custkey + f.f*5 + case when (o_orderkey + s.s*3 + f.f) % 4 = 0 then s.s+1 else 0 end) % 50 as varchar)) as v
              from cc, (values (0),(1),(2)) s(s), (values (0),(1),(2),(3),(4),(5),(6)) f(f) where (o_orderkey*31 + s.s*s.s*17 + f.f*13) % 10 < 6))""",
    "cal": f"""cal as (select {_case(SOURCES, 's')} as structurer, {_case(COUNTRIES, 'n')} as country, {_case(FIELD_OF, 'f')} as field, 0.2::double as raw_low, 0.8::double as raw_high, 0.1::double as cal_low, (90 - n)::double/100 as cal_high
        from (select n_nationkey as n from nation where n_nationkey < 9), (values (0),(1),(2)) s(s), (values (0),(1),(2),(3),(4),(5),(6)) f(f) where (n + s + f) % 3 = 0)""",
    "dict": f"""dict as (select f.field, concat('val', cast(n_nationkey as varchar)) as key, case f.field when 'CTRY' then case when n_nationkey < 9 then {_case(COUNTRIES, 'n_nationkey')} else n_name end
        when 'CTRY_SUB_DVSN' then concat('Region ', cast(n_nationkey as varchar)) when 'STRT_NM' then concat('Street ', cast(n_nationkey % 5 as varchar)) else 'House' end as canonical
        from nation, (values ('CTRY'), ('CTRY_SUB_DVSN'), ('STRT_NM'), ('BLDG_NM')) f(field))""",
    "results": "results as (select o_orderkey as result_id, country, (o_orderkey*37 % 101)::decimal(5,2)/100 as overall_confidence, case when o_orderkey*37 % 101 < 70 then 'Y' else 'N' end as requires_review, o_orderdate as created_at, o_custkey % 7 as latency_ms from cc)",
    "attr": f"""attr as (select l_orderkey as result_id, {_case(COUNTRIES, 'l_suppkey % 10')} as country, {_case(FIELD_OF, 'l_partkey % 7')} as field, {_case(SOURCES, 'l_linenumber % 3')} as structurer,
        ((l_orderkey*13 + l_linenumber) % 101)::double/100 as raw_confidence, ((l_orderkey*13 + l_linenumber) % 101 * (l_partkey % 2 + 1) % 101) as c100, l_quantity as latency_ms, case when l_linestatus = 'O' then 'Y' else 'N' end as was_selected, l_shipdate as created_at from lineitem)""",
    "feedback": f"feedback as (select l_orderkey as result_id, {_case(COUNTRIES, 'l_suppkey % 10')} as country, {_case(FIELD_OF, 'l_partkey % 7')} as field, l_shipdate as corrected_at from lineitem where l_returnflag = 'R')",
    "verdicts": "verdicts as (select o_orderkey as result_id, country, o_orderdate as reviewed_at, f.n as field, case when (o_orderkey + f.i) % 5 = 0 then 0.0 else 1.0 end as ok from cc, (values (0,'CTRY'),(1,'TWN_NM'),(2,'STRT_NM'),(3,'PST_CD')) f(i, n) where o_orderstatus = 'F')",
    "routing": f"""routing as (select event_id, {_case(COUNTRIES, 'user_id % 10')} as country, case when event_type = 'error' then 'BLOCK' when event_type in ('purchase','signup') then 'ROUTE' else 'BYPASS' end as decision,
        case when event_type = 'error' then 'SANCTIONS_PATTERN_MATCH' when user_id % 2 = 0 then 'LOW_OVERALL_CONFIDENCE' else 'LOW_FIELD_CONFIDENCE' end as primary_reason,
        case user_id % 3 when 0 then 'PASS' when 1 then 'REJECT' else 'NEEDS_REVIEW' end as compliance_verdict, case when user_id % 10 < 9 then 'RESOLVED' else 'PENDING' end as status, ts as created_at, event_id % 9000 as latency from events)""",
}


def sql(body: str, *needs: str) -> str:
    """``body`` over the named derivations."""
    return "with " + ", ".join(SQL[n] for n in needs) + " " + body if needs else body
