"""Unit cases: merge, consensus, review, compliance, keys, normalisation, ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfold.functions import scores, text
from wayfold.operators import accuracy, consensus, decide, dedup, merge, normalize, queue, sampling
from wayfold.plans import config, ingest_queries
from wayfold.plans import enrich as plan
from wayfold.sources import payments, reference, sinks, structurers
from wayfold.sources import requests as rq

CAND = "request_id long, structurer string, cascade_pos int, field string, value string, raw_confidence double, country string"


def cands(spark, rows, country="US"):
    order = {s: k for k, s in enumerate(config.STRUCTURERS)}
    return spark.createDataFrame([(r, s, order[s], f, v, c, country) for r, s, f, v, c in rows], CAND)


def voted(spark, rows):
    df = cands(spark, rows).withColumn("confidence", scores.clamp(F.col("raw_confidence")))
    return {(r.request_id, r.field): (r.value, round(r.confidence, 6), r.merge_strategy) for r in merge.vote(df).collect()}


def test_vote(spark):
    got = voted(
        spark,
        [
            (1, "libpostal", "CTRY", "US", 0.9),
            (2, "libpostal", "CTRY", "US", 0.6),
            (2, "glm", "CTRY", "GB", 0.8),
            (3, "libpostal", "CTRY", "US", 0.7),
            (3, "glm", "CTRY", "GB", 0.7),
            (4, "libpostal", "CTRY", "", 0.9),
            (4, "glm", "CTRY", "GB", 0.2),
            (5, "libpostal", "TWN_NM", "Leeds", 0.6),
            (5, "glm", "TWN_NM", "LEEDS ", 0.8),
            (5, "azure-gpt", "TWN_NM", "York", 0.99),
            (6, "glm", "TWN_NM", "x", 7.0),
            (7, "glm", "TWN_NM", None, 0.5),
        ],
    )
    assert got[1, "CTRY"] == ("US", 0.9, "SINGLE_SOURCE")
    assert got[2, "CTRY"] == ("GB", 0.8, "HIGHEST_CONFIDENCE")
    assert got[3, "CTRY"] == ("US", 0.7, "HIGHEST_CONFIDENCE")  # a tie keeps the earlier source
    assert got[4, "CTRY"] == ("GB", 0.2, "SINGLE_SOURCE")
    assert got[5, "TWN_NM"] == ("LEEDS ", 0.88, "CONSENSUS")
    assert got[6, "TWN_NM"] == ("x", 1.0, "SINGLE_SOURCE")
    assert (7, "TWN_NM") not in got


def test_vote_does_not_depend_on_order(spark):
    rows = [(k % 7, s, f, f"v{(k * i) % 3}", (k * 13 + i) % 10 / 10) for k in range(40) for i, (s, f) in enumerate([("libpostal", "CTRY"), ("glm", "CTRY"), ("azure-gpt", "TWN_NM")])]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    assert voted(spark, rows) == voted(spark, rows[::-1])


@pytest.mark.parametrize(("raw", "want"), [(0.1, 0.2), (0.5, 0.55), (0.9, 0.9), (float("nan"), 0.0), (float("inf"), 0.0)])
def test_calibration(spark, raw, want):
    table = spark.createDataFrame([("glm", "us", "CTRY", 0.2, 0.8, 0.2, 0.9)], reference.CALIBRATION)
    rows = merge.calibrate(cands(spark, [(1, "glm", "CTRY", "US", raw), (1, "libpostal", "CTRY", "US", raw)]), table).collect()
    assert {r.structurer: round(r.confidence, 6) for r in rows}["glm"] == want


def test_consensus(spark):
    def one(rows, country):
        df = cands(spark, [(1, *r) for r in rows], country)
        fields = consensus.by_field(df)
        r = consensus.by_request(fields, df).first()
        return r.agreements, r.disagreements, r.flagged_fields, r.source_count

    weak = [("libpostal", "TWN_NM", "A", 0.9), ("glm", "TWN_NM", "B", 0.9)]
    assert one(weak, "CN") == (1, 0, [], 2)
    assert one(weak, "US") == (0, 1, ["TWN_NM"], 2)
    assert one([("libpostal", "TWN_NM", "A", 0.9)], "CN") == (0, 1, ["TWN_NM"], 1)
    assert one([("glm", "TWN_NM", "A ", 0.9), ("azure-gpt", "TWN_NM", "a", 0.9)], "") == (1, 0, [], 2)
    free = spark.range(1).select(consensus.weight(F.lit("libpostal"), F.lit("CN"), {}).alias("w")).first().w
    assert free == 1.0


FIELDS = "request_id long, raw string, country_hint string, fields map<string,struct<value:string,confidence:double,merge_strategy:string>>, disagreements long, source_count long"


def decided(spark, fields, raw="1 Main St", hint="US", dis=0, n=2, **settings):
    m = {k: (v, c, "CONSENSUS") for k, (v, c) in fields.items()} if fields is not None else None
    df = spark.createDataFrame([(1, raw, hint, m, dis, n)], FIELDS).withColumn("overall_confidence", decide.overall_confidence())
    return plan.decided(df, **settings).first()


GOOD = {"CTRY": ("US", 0.99), "TWN_NM": ("Boston", 0.95), "CTRY_SUB_DVSN": ("MA", 0.9)}


def test_decisions(spark):
    open_ = config.COMPLIANCE | {"shadow": False}
    r = decided(spark, GOOD, config=open_)
    assert (r.outcome, r.decision, r.recommendation, r.reasons) == ("SUCCESS", "BYPASS", "AutoApproved", [])
    r = decided(spark, GOOD, raw="Bank  Melli, Tehran", config=open_)
    assert (r.decision, r.primary_reason, r.urgency) == ("ROUTE", "SANCTIONS_PATTERN_MATCH", "EXPEDITED")
    r = decided(spark, GOOD, raw="bank melli")  # shadow mode keeps what it would have decided
    assert (r.decision, r.would_decision) == ("BYPASS", "ROUTE")
    r = decided(spark, {"CTRY": ("IR", 0.99), "TWN_NM": ("Qom", 0.6)}, config=open_)
    assert r.reasons == ["LOW_FIELD_CONFIDENCE", "LOW_OVERALL_CONFIDENCE", "HIGH_RISK_COUNTRY"]
    assert (r.outcome, r.exception_reason, r.primary_reason) == ("REQUIRES_REVIEW", "LOW_CONFIDENCE", "LOW_FIELD_CONFIDENCE")
    r = decided(spark, {"CTRY": ("US", 0.99)}, config=open_)
    assert (r.exception_reason, r.reasons[-1]) == ("MISSING_REQUIRED", "SCHEMA_INCOMPLETE")
    r = decided(spark, {}, config=open_)
    assert (r.outcome, "UNSTRUCTURABLE" in r.reasons, r.evaluated_by_service) == ("UNSTRUCTURABLE", True, False)
    r = decided(spark, None, config=open_)  # nothing to evaluate: the careful way
    assert (r.decision, r.urgency) == ("ROUTE", "BLOCKING")
    r = decided(spark, None, config=config.COMPLIANCE | {"fail_safe": "OPEN"})
    assert r.decision == "BYPASS"
    r = decided(spark, GOOD, dis=2, n=1, hint="IR")
    assert [x.rule for x in r.review_reasons] == ["consensus-disagreement", "single-source", "high-risk-country"]
    assert (r.outcome, r.requires_review) == ("REQUIRES_REVIEW", "N")
    r = decided(spark, {"CTRY": ("CN", 0.9), "TWN_NM": ("Wuhan", 0.66)}, hint="CN")
    assert r.first_outcome == "SUCCESS"  # the country's own threshold
    odd = ({"name": "x", "enabled": True, "type": "NO_SUCH", "params": {}}, {"name": "y", "enabled": False, "type": "SINGLE_SOURCE", "params": {}}, {"name": "z", "enabled": True, "type": "LOW_CONFIDENCE", "params": {"threshold": "bad"}})
    assert decided(spark, {"CTRY": ("US", 0.5), "TWN_NM": ("B", 0.5)}, rules=odd).review_reasons[0].details == "confidence=0.500 < threshold=0.700"


def test_format_issues(spark):
    def issues(country, **fields):
        m = {k: (v, 0.9, "CONSENSUS") for k, v in fields.items()}
        df = spark.createDataFrame([(1, country, m)], "request_id long, country string, fields map<string,struct<value:string,confidence:double,merge_strategy:string>>")
        return {(r.field, r.severity) for r in decide.issues_table(df).collect()}

    assert issues("gb", CTRY="GB", TWN_NM="London", PST_CD="ec1a 1bb") == set()
    assert issues("US", CTRY="US", TWN_NM="B", PST_CD="123") == {("PST_CD", "WARNING")}
    assert issues("AE", CTRY="AE", TWN_NM="Dubai", PST_CD="1") == {("PST_CD", "WARNING")}
    assert issues("US", CTRY="USA", TWN_NM="B") == {("PST_CD", "INFO"), ("CTRY", "ERROR")}
    assert issues("US") == {("CTRY", "ERROR"), ("TWN_NM", "ERROR")}
    assert issues("") == set()


def test_keys(spark):
    rows = [(1, " 10  Main St\t", "US", "HTTP"), (2, "10 main st", "US", "KAFKA"), (3, "10 main st", "GB", "HTTP")]
    df = spark.createDataFrame([(i, f"c{i}", r, h, s, i) for i, r, h, s in rows], "request_id long, correlation_id string, raw string, country_hint string, source_channel string, arrival_ts long")
    keyed = dedup.with_key(df)
    keys = {r.request_id: r.idem_key for r in keyed.collect()}
    assert keys[1] == keys[2] != keys[3] and len(keys[1]) == 64
    empty = spark.createDataFrame([], "idem_key string")
    once = dedup.claim(keyed, empty)
    assert sorted(r.request_id for r in once.collect()) == [1, 3]
    assert dedup.claim(keyed, once.select("idem_key")).count() == 0  # a second run claims nothing
    assert sorted(r.request_id for r in dedup.first_claims(keyed).where("claim = 1").collect()) == [1, 3]
    old = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 2, 20))], "idem_key string, processed_at timestamp")
    assert [r.idem_key for r in dedup.purge(old, dt.datetime(2024, 3, 1)).collect()] == ["b"]


def test_normalisation(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# streets\nAvenue|Ave|Av\nRue|R\n")
    (tmp_path / "b.txt").write_text("Street|St|Ave\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_text("US|United States|U.S.A\n")
    words = reference.dictionary(spark, str(tmp_path / "*.txt"), "STRT_NM").unionByName(reference.dictionary(spark, str(tmp_path / "c"), "CTRY"))
    df = cands(spark, [(1, "glm", "STRT_NM", " Madison   Ave., ", 1.0), (2, "glm", "STRT_NM", "R. de Lyon;", 1.0), (3, "glm", "CTRY", "united states", 1.0), (4, "glm", "CTRY", "gb", 1.0), (5, "glm", "CTRY", " \t", 1.0), (6, "glm", "TWN_NM", " Zürich ,", 1.0), (7, "glm", "STRT_NM", "Ave", 1.0)])
    full = {r.request_id: r.value for r in normalize.all_fields(df, words).collect()}
    assert full == {1: "Madison Avenue", 2: "Rue de Lyon", 3: "US", 4: "GB", 6: "Zürich", 7: "Avenue"}
    only = {r.request_id: r.value for r in normalize.countries_only(df, words).collect()}
    assert only == {1: " Madison   Ave., ", 2: "R. de Lyon;", 3: "US", 4: "GB", 6: " Zürich ,", 7: "Ave"}


def test_reference_files(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("# made by hand\n\ncountry,field,raw_low,raw_high,calibrated_low,calibrated_high\nus,CTRY,0.1,0.9,0.2,0.8\nshort,row\n")
    assert [tuple(r) for r in reference.calibration(spark, str(tmp_path / "cal.csv"), "glm").collect()] == [("glm", "US", "CTRY", 0.1, 0.9, 0.2, 0.8)]
    (tmp_path / "set.csv").write_text("# c\nir\n kp \n\nIR\n")
    assert sorted(r.country for r in reference.country_set(spark, str(tmp_path / "set.csv")).collect()) == ["IR", "KP"]
    assert reference.patterns(spark, str(tmp_path / "set.csv")).count() == 3


def test_text(spark):
    row = spark.createDataFrame([(" \x01a,  b ;.\n", None)], "a string, b string").select(text.tidy(F.col("a")).alias("tidy"), text.canonical(F.col("a")).alias("canonical"), text.split_parts(F.lit("x, y,, ,")).alias("parts"), text.join_lines(F.lit(" a "), F.lit(" "), F.col("b"), F.lit("c")).alias("joined"), text.clean_hint(F.col("b")).alias("hint"), structurers.gulf_text(F.lit("SZR, Dubai, U.A.E. P.O Box 12")).alias("gulf")).first()
    assert row.tidy == "a, b" and row.canonical == "a, b ;." and row.parts == ["x", "y"] and row.joined == "a, c" and row.hint == ""
    assert row.gulf == "Sheikh Zayed Road, Dubai, United Arab Emirates. PO Box 12"


def test_messages(spark):
    rows = [(b'{"rawAddress":"1 Main St","countryHint":"us"}', b"k1", None), (b"{bad", None, None), (b'{"countryHint":"US"}', None, "h"), (b'{"rawAddress":"x"}', None, None)]
    df = spark.createDataFrame(rows, "value binary, key binary, correlation_header string")
    good, bad = rq.validate(rq.parse_messages(df))
    got = {r.raw: r for r in good.collect()}
    assert set(got) == {"1 Main St", "x"} and got["1 Main St"].country_hint == "US" and got["1 Main St"].correlation_id == "k1" and len(got["x"].correlation_id) == 64
    assert sorted(r.reject_reason for r in bad.collect()) == ["BLANK_ADDRESS", "MALFORMED"]
    retry, dead = sinks.dead_letters(bad)
    assert (retry.count(), dead.count()) == (0, 2)


def test_batches(spark):
    item = ("a", "US", "")
    df = spark.createDataFrame([("b1", [item] * 2), ("b2", [item] * 101), ("b3", [])], rq.BATCH)
    good, refused = rq.expand_batches(df)
    assert sorted(r.correlation_id for r in good.collect()) == ["b1/0", "b1/1"]
    assert [tuple(r) for r in refused.collect()] == [("b2", 101)]


XML = "<Document><FIToFICstmrCdtTrf><CdtTrfTxInf><Dbtr><Nm>A</Nm><PstlAdr><Ctry>US</Ctry><AdrLine>1 Main St</AdrLine><AdrLine>Boston</AdrLine></PstlAdr></Dbtr><Cdtr><PstlAdr><Ctry>GB</Ctry><TwnNm>London</TwnNm></PstlAdr></Cdtr></CdtTrfTxInf></FIToFICstmrCdtTrf></Document>"


def test_payments(spark):
    df = spark.createDataFrame([("m1", XML), ("m2", "<oops")], "message_id string, xml string")
    rows = payments.parties(df)
    assert sorted(r.correlation_id for r in rows.collect()) == ["m1/0/Cdtr", "m1/0/Dbtr"]
    asked = payments.to_requests(rows).collect()
    assert [tuple(r) for r in asked] == [("m1/0/Dbtr", "1 Main St, Boston", "US")]
    results = spark.createDataFrame([("m1/0/Dbtr", "SUCCESS", {"CTRY": ("US", 0.9, "X"), "TWN_NM": ("Boston", 0.9, "X")})], "correlation_id string, outcome string, fields map<string,struct<value:string,confidence:double,merge_strategy:string>>")
    back = {r.role: r for r in payments.write_back(rows, results).collect()}
    assert back["Dbtr"].PstlAdr.TwnNm == "Boston" and "<TwnNm>Boston</TwnNm>" in back["Dbtr"].xml and back["Cdtr"].PstlAdr.TwnNm == "London"
    fields = rows.where("role = 'Cdtr'").select(payments.from_postal().alias("f")).first().f
    assert {k: v.value for k, v in fields.items()} == {"CTRY": "GB", "TWN_NM": "London"}
    event = spark.createDataFrame([('{"id":"e1","type":"t","data":' + __import__("json").dumps(XML) + "}",)], "value string")
    assert payments.event_parties(event).count() == 2
    lines = spark.createDataFrame([("r1", "50K", "/123\nACME LTD\n1 MAIN ST\nBOSTON"), ("r1", "71A", "x")], "message_id string, tag string, lines string")
    assert [tuple(r) for r in payments.line_parties(lines).collect()] == [("r1/50K", "1 MAIN ST, BOSTON")]


def test_structurers(spark):
    req = spark.createDataFrame([(1, "x", "US"), (2, "y", "GB")], "request_id long, raw string, country_hint string")
    tokens = spark.createDataFrame([(1, [("10", "house_number"), (" ", "road"), ("Main St", "road"), ("Elm St", "road"), ("usa", "country"), ("?", "level")]), (2, [("Leeds", "city"), ("Hall", "house")])], "request_id long, tokens array<struct<value:string,label:string>>")
    got = {(r.request_id, r.field): (r.value, r.raw_confidence) for r in structurers.allowed(structurers.from_labels(tokens, req)).collect()}
    assert got == {(1, "BLDG_NB"): ("10", 0.85), (1, "STRT_NM"): ("Main St", 0.85), (1, "CTRY"): ("usa", 0.85), (2, "TWN_NM"): ("Leeds", 0.85), (2, "CTRY"): ("GB", 0.70)}
    answers = spark.createDataFrame([(1, '```json\n{"fields":{"CTRY":{"value":"US","confidence":0.9},"country":"GB","junk":"x"}}\n```'), (2, "not json"), (3, '{"address":{"city":"Rome"}}'), (4, '{"zip":"123","town":""}')], "request_id long, content string")
    got = {(r.request_id, r.field): (r.value, r.raw_confidence) for r in structurers.from_responses(answers, "glm").collect()}
    assert got == {(1, "CTRY"): ("US", 0.9), (3, "TWN_NM"): ("Rome", 0.85), (4, "PST_CD"): ("123", 0.85)}
    env = spark.createDataFrame([('{"choices":[{"message":{"content":"","reasoning_content":"r"}}],"usage":{"prompt_tokens":3}}',), ("bad",)], "body string")
    assert [(r.content, r.finish_reason, r.input_tokens, r.output_tokens) for r in structurers.envelope(env).collect()] == [("r", "stop", 3, 0), ("", "stop", 0, 0)]
    more = spark.createDataFrame([("US", "Mind the state.")], "country string, supplement string")
    said = {r.request_id: r.prompt for r in structurers.prompts(req.withColumn("locale", F.lit("en")), "Parse {{raw}} ({{countryHint}}, {{locale}})", more).collect()}
    assert said == {1: "Parse x (US, en)\nMind the state.", 2: "Parse y (GB, en)"}
    first = spark.createDataFrame([(1, "glm", "CTRY", 2, "b", 0.1), (1, "glm", "CTRY", 0, "a", 0.2)], "request_id long, structurer string, field string, pos int, value string, raw_confidence double")
    assert [r.value for r in merge.first_of_each(first).collect()] == ["a"]
    assert {r.cascade_pos for r in structurers.union_all(first, first.withColumn("structurer", F.lit("new")), order=("glm",)).collect()} == {0, 1}


def test_queue_shares_are_disjoint(spark):
    q = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k % 3), "OPEN", 1, None, None) for k in range(9)], "item_id long, created_at timestamp, status string, version int, assigned_to string, resolution string")
    rows = queue.shares(q, ["a", "b"], 3).collect()
    one, two = ({r.item_id for r in rows if r.reviewer == x} for x in "ab")
    assert len(one) == len(two) == 3 and not one & two


def test_samples_repeat_for_a_seed(spark):
    df = spark.createDataFrame([(k, "US", k % 100 / 100, dt.datetime(2024, 1, 1)) for k in range(300)], "result_id long, country string, overall_confidence double, created_at timestamp")
    at = F.lit(dt.datetime(2024, 1, 1, 12))
    first, again = (sorted(r.result_id for r in sampling.for_review(df, at, seed=3).collect()) for _ in range(2))
    assert first == again and len(first) == 10


def test_golden_files(spark, tmp_path):
    for folder, name, body in (("US", "a", '{"value":"US","required":true}'), ("US", "b", '"GB"')):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(f'{{"fixture_id":"{name}","country":"US","raw":"x","expected_fields":{{"CTRY":{body}}}}}')
    fixtures, expected = rq.golden(spark, str(tmp_path))
    assert {(r.fixture_id, r.expected, r.required) for r in expected.collect()} == {("a", "US", True), ("b", "GB", None)}
    assert [r.fixture_id for r in rq.sampled(fixtures).collect()] == ["a"]
    actual = spark.createDataFrame([("a", "CTRY", "us")], "fixture_id string, field string, value string")
    compared = accuracy.compare(expected, actual)
    scored = accuracy.by_fixture(compared, fixtures.select("fixture_id", "country"))
    assert {r.fixture_id: r.accuracy for r in scored.collect()} == {"a": 1.0, "b": 0.0}
    report = {r.fixture_id: r.fields for r in accuracy.flat_report(scored, compared).collect()}
    assert report == {"a": "CTRY=US/us", "b": "CTRY=GB/"}
    assert {(r.expected, r.actual, r.n) for r in accuracy.confusion(compared).collect()} == {("US", "US", 1), ("GB", "", 1)}
    assert [r.enough for r in accuracy.coverage(fixtures).collect()] == [False]
    whole = accuracy.summary(scored.withColumns({"latency_ms": F.lit(1), "outcome": F.lit("SUCCESS"), "disagreements": F.lit(0)}))
    assert [(r.country, r.tier, r.passed) for r in accuracy.gates(whole).collect()] == [("US", 0, False)]
    outside = spark.createDataFrame([("10 Main St", "United States", {"road": "Main St", "level": "2"}), ("short", "United States", {}), ("10 Main St", "Nowhere", {})], "address string, country_name string, labels map<string,string>")
    assert [(r.fixture_id, r.expected_fields) for r in rq.external_fixtures(outside, {"United States": "US"}).collect()] == [("US-001", {"STRT_NM": "Main St"})]


def test_golden_files_of_many_fixtures(spark, tmp_path):
    for folder, file, names in (("US", "1.json", "cb"), ("US", "2.json", "a"), ("GB", "1.json", "ed")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / file).write_text("\n".join(f'{{"fixture_id":"{n}","country":"{folder}","raw":"x","expected_fields":{{"CTRY":"{folder}"}}}}' for n in names))
    fixtures, expected = rq.golden(spark, str(tmp_path), lines=True)
    assert {(r.fixture_id, r.expected) for r in expected.collect()} == {("a", "US"), ("b", "US"), ("c", "US"), ("d", "GB"), ("e", "GB")}
    assert sorted(r.fixture_id for r in rq.sampled(fixtures).collect()) == ["b", "d"]


def test_golden_query_writes_few_files(spark, monkeypatch, tmp_path):
    """Files do not grow with the fixtures, and the sampled one is the first of its country."""
    tables = {"supplier": spark.range(3000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey"), F.lit("x").alias("s_name"))}
    monkeypatch.setattr(ingest_queries.d, "table", lambda spark, sf_dir, name: tables[name])
    monkeypatch.setattr(ingest_queries.shared, "folder", lambda spark, name: str(tmp_path / name))
    rows = ingest_queries.s10_s12_golden_files(spark, "").collect()
    assert len(rows) == 3000 and sorted(r.fixture_id for r in rows if r.sampled) == ["s000000000", "s000000001", "s000000002"]
    assert len(list((tmp_path / "golden").rglob("part-*"))) <= 100


def test_error_triage(spark):
    df = spark.createDataFrame([("TIMEOUT",), ("VALIDATION",), ("NEW",)], "error string")
    assert [(r.retryable, r.http_status) for r in decide.triage(df).collect()] == [(True, 504), (False, 400), (False, 500)]


def test_files_of_requests_reports_and_prompts(spark, tmp_path):
    (tmp_path / "adhoc.json").write_text('[{"fixture_id":"a","country":"US","raw":"1 Main St","country_hint":"US","locale":"en"},{"fixture_id":"b","raw":"x"}]')
    assert [(r.fixture_id, r.country_hint) for r in rq.adhoc(spark, str(tmp_path / "adhoc.json")).orderBy("fixture_id").collect()] == [("a", "US"), ("b", None)]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "us.txt").write_text("Mind the state.")
    assert [tuple(r) for r in reference.prompt_supplements(spark, str(tmp_path / "prompts")).collect()] == [("US", "Mind the state.")]
    sinks.write_csv(spark.createDataFrame([("a", 1.0)], "fixture_id string, accuracy double"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == [("a", "1.0")]
    order = spark.createDataFrame([("TWN_NM",), ("CTRY",)], "field string").select("field", decide.field_order(F.col("field")).alias("place")).collect()
    assert {r.field: r.place for r in order} == {"CTRY": 0, "TWN_NM": 1}


def test_sources_with_two_values_of_a_field_do_not_break_the_consensus(spark):
    df = cands(spark, [(1, "glm", "CTRY", "US", 0.9), (1, "glm", "CTRY", "GB", 0.8), (1, "azure-gpt", "CTRY", "FR", 0.7)])
    r = consensus.by_field(df).first()
    assert (r.agreed, r.n_values, r.alternatives) == (False, 3, {"azure-gpt": "FR", "glm": "GB"})
    mixed = df.withColumn("country", F.when(F.col("value") == "US", "US").otherwise("CN"))
    assert consensus.by_request(consensus.by_field(mixed), mixed).first().source_count == 2


def test_empty_answers_leave_a_field_to_the_next_alias(spark):
    rows = spark.createDataFrame([(1, '{"city":"","town":"Rome"}')], "request_id long, content string")
    assert [r.value for r in structurers.from_responses(rows, "glm").collect()] == ["Rome"]
