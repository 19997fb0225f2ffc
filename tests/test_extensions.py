"""Payment files split at transactions, own structurers and calibrators, alternatives in the vote."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from wayfold.operators import alternatives, merge
from wayfold.plans import ingest_queries, queries
from wayfold.plans.extensions import Extensions
from wayfold.sources import payment_files, payments, structurers

# Payment files


def transaction(k):
    party = f"<Dbtr><Nm>N</Nm>\n<PstlAdr><Ctry>US</Ctry><AdrLine>{k} Main St</AdrLine></PstlAdr></Dbtr>"
    return f"<CdtTrfTxInf>{party}<Cdtr><PstlAdr><Ctry>GB</Ctry><TwnNm>Town {k % 7}</TwnNm></PstlAdr></Cdtr>\n</CdtTrfTxInf>\n"


def message(name, numbers):
    return f"<Document><FIToFICstmrCdtTrf><GrpHdr><MsgId>{name}</MsgId></GrpHdr>" + "".join(map(transaction, numbers)) + "</FIToFICstmrCdtTrf></Document>\n"


def said(rows):
    return sorted((r.message_id, r.tx, r.role, r.correlation_id, r.PstlAdr.asDict(recursive=True).__repr__()) for r in rows.collect())


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_large_message_is_read_by_several_tasks(spark, tmp_path, small_splits):
    text = message("m1", range(8000))
    (tmp_path / "a.xml").write_text(text)
    landed = payment_files.land(spark, str(tmp_path / "a.xml"), str(tmp_path / "landed"))
    assert landed.select("block").distinct().count() > 3
    whole = payments.parties(spark.createDataFrame([("m1", text)], "message_id string, xml string"))
    got = said(payment_files.parties(landed))
    assert len(got) == 16000 and got == said(whole)


def test_many_messages_and_odd_files(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    lengths = {"a": 1, "b": 4000, "c": 0, "d": 2, "e": 3000, "f": 1}
    (folder / "many.xml").write_text("".join(message(m, range(n)) for m, n in lengths.items()))
    (folder / "bare.xml").write_text("".join(map(transaction, range(2))))
    (folder / "broken.xml").write_text("<Document><GrpHdr><MsgId>x</MsgId></GrpHdr>" + transaction(0) + "<CdtTrfTxInf><Dbtr></CdtTrfTxInf>" + transaction(2) + "</Document>")
    (folder / "empty.xml").write_text("")
    rows = payment_files.parties(payment_files.land(spark, str(folder), str(tmp_path / "landed"))).where("role = 'Dbtr'")
    got = sorted((r.message_id, r.tx, r.PstlAdr.AdrLine[0]) for r in rows.collect())
    want = [(m, k, f"{k} Main St") for m, n in lengths.items() for k in range(n)] + [("bare.xml", k, f"{k} Main St") for k in range(2)] + [("x", k, f"{k} Main St") for k in (0, 2)]
    assert got == sorted(want)


# Structurers and calibrators by name


def test_structurer_in_sql_and_in_the_union(spark):
    def words(requests):
        rows = [(k, f, v, c) for k, raw in zip(requests["request_id"].to_pylist(), requests["raw"].to_pylist(), strict=True) for f, v, c in (("TWN_NM", (raw or "").split(" ")[0], 0.5), ("STRT_NM", " ", 0.9), ("BLDG_NM", "no", 0.9))]
        return pa.table({n: [r[i] for r in rows] for i, n in enumerate(("request_id", "field", "value", "raw_confidence"))})

    own = Extensions(spark)
    own.structurer("words", words, fields=("TWN_NM", "STRT_NM"))
    own.add("commas", structurers.comma_parts, fields=("CTRY", "TWN_NM"))
    df = spark.createDataFrame([(1, "Bonn, Weg", "DE"), (2, None, ""), (3, "Ulm", "DE")], "request_id long, raw string, country_hint string")
    df.createOrReplaceTempView("few_requests")
    got = spark.sql("select * from structure_words(table(few_requests)) order by request_id").collect()
    assert [(r.request_id, r.structurer, r.field, r.value) for r in got] == [(1, "words", "TWN_NM", "Bonn,"), (3, "words", "TWN_NM", "Ulm")]
    both = {(r.request_id, r.structurer, r.field, r.value, r.cascade_pos) for r in own.candidates(df, "commas", "words").collect()}
    assert {(1, "commas", "TWN_NM", "Bonn", 0), (1, "words", "TWN_NM", "Bonn,", 1), (3, "commas", "CTRY", "DE", 0)} <= both
    assert not any(f == "STRT_NM" or f == "BLDG_NM" for _, _, f, _, _ in both)
    assert own.candidates(df.limit(0)).count() == 0
    # batches are read where they are: no exchange
    assert "Exchange" not in own.structurers["words"](df)._jdf.queryExecution().executedPlan().toString()


def test_each_row_meets_its_own_calibrator(spark):
    own = Extensions(spark)
    own.calibrator("half", lambda raw, field, country: raw / 2)
    own.calibrator("wild", lambda raw, field, country: raw * 100 - 20 * (field == "CTRY"))
    rows = [(1, "a", "US", "CTRY", 0.8), (1, "b", "US", "CTRY", 0.2), (1, "b", "US", "PST_CD", None), (1, "c", "US", "CTRY", 0.5), (1, "c", "US", "PST_CD", 0.5), (1, "b", None, "CTRY", float("nan"))]
    df = spark.createDataFrame(rows, "request_id long, structurer string, country string, field string, raw_confidence double")
    table = spark.createDataFrame([("c", "US", "CTRY", 0.0, 1.0, 0.0, 0.4), ("a", "US", "CTRY", 0.0, 1.0, 0.0, 0.1)], "structurer string, country string, field string, raw_low double, raw_high double, cal_low double, cal_high double")
    got = {(r.structurer, r.country, r.field): r.confidence for r in own.calibrate(df, {"a": "half", "b": "wild"}, table).collect()}
    assert got == {("a", "US", "CTRY"): 0.4, ("b", "US", "CTRY"): 0.0, ("b", "US", "PST_CD"): 0.0, ("b", None, "CTRY"): 0.0, ("c", "US", "CTRY"): 0.2, ("c", "US", "PST_CD"): 0.5}
    assert own.calibrate(df, {}, table).count() == 6
    assert spark.sql("select calibrate_wild(0.5D, 'PST_CD', 'US') as x").first().x == 1.0


# Alternatives


def resolved(spark, rows):
    schema = "request_id long, structurer string, cascade_pos int, field string, value string, raw_confidence double, alternatives array<struct<value:string,confidence:double>>, country string"
    none = spark.createDataFrame([], "structurer string, country string, field string, raw_low double, raw_high double, cal_low double, cal_high double")
    out = alternatives.resolve(merge.calibrate(alternatives.ranked(spark.createDataFrame(rows, schema)), none)).collect()
    return {r.request_id: r for r in out}


def test_an_alternative_wins_and_sources_count_once(spark):
    got = resolved(spark, [
        (1, "glm", 0, "TWN_NM", "Bonn", 0.9, [("Koeln", 0.5), ("Ulm", 0.4)], "DE"),
        (1, "azure-gpt", 1, "TWN_NM", "Berlin", 0.8, [(" ", 0.7), ("ulm ", 0.6)], "DE"),
        (2, "glm", 0, "TWN_NM", "Bonn", 0.9, [("bonn", 0.8), ("BONN ", 0.7)], "DE"),
        (3, "glm", 0, "TWN_NM", "Bonn", 0.4, None, "DE"),
        (3, "azure-gpt", 1, "TWN_NM", "Ulm", 0.5, [], "DE"),
        (4, "glm", 0, "TWN_NM", "Bonn", 0.9, [("Ulm", 0.2)], "CN"),
        (4, "azure-gpt", 1, "TWN_NM", "Ulm", 0.5, None, "CN"),
        (4, "libpostal", 2, "TWN_NM", "Wien", 0.95, None, "CN"),
        (5, "glm", 0, "TWN_NM", None, 0.9, [("Graz", 0.3)], "AT"),
        (6, "glm", 0, "TWN_NM", "", 0.9, None, "AT"),
    ])
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert (one.value, one.merge_strategy, one.sources, one.rank, one.shared) == ("ulm ", "CONSENSUS", 2, 2, True)
    assert one.confidence == pytest.approx(0.6 * 1.1) and one.choices == {"glm": ["Bonn", "Koeln", "Ulm"], "azure-gpt": ["Berlin", "ulm "]}
    assert (got[2].merge_strategy, got[2].value, got[2].rank, got[2].shared) == ("SINGLE_SOURCE", "Bonn", 0, True)
    assert (got[3].merge_strategy, got[3].value, got[3].shared) == ("HIGHEST_CONFIDENCE", "Ulm", False)
    # the weak source of that country has no say in whether the strong ones agree
    assert (got[4].value, got[4].merge_strategy, got[4].rank, got[4].shared) == ("Ulm", "CONSENSUS", 0, True)
    assert (got[5].value, got[5].rank) == ("Graz", 1)


def test_vote_without_alternatives_is_the_plain_vote(spark, sf_dir):
    from wayfold.plans import derived as d

    rows = merge.calibrate(d.candidates(spark, sf_dir), d.calibration(spark, sf_dir))
    plain = merge.vote(rows).select("request_id", "field", "value", "confidence", "merge_strategy", "sources")
    none = alternatives.ranked(d.candidates(spark, sf_dir).withColumn("alternatives", F.lit(None).cast("array<struct<value:string,confidence:double>>")))
    other = alternatives.resolve(merge.calibrate(none, d.calibration(spark, sf_dir))).select(*plain.columns)
    assert plain.exceptAll(other).count() == 0 and other.exceptAll(plain).count() == 0


def test_wire_answers(spark):
    bodies = ['{"fields":{"CTRY":{"value":"DE","confidence":0.7,"alternatives":[{"value":"AT","confidence":0.2}]},"EXTRA":{"value":"x"},"PST_CD":{"value":" "}},"structurerVersion":"v2"}', "{cut", None, '{"fields":{"CTRY":{"value":"FR"}}}']
    rows = structurers.from_wire(spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string"), "own").collect()
    got = {r.request_id: (r.field, r.value, r.raw_confidence, r.alternatives and [tuple(a) for a in r.alternatives], r.version) for r in rows}
    assert got == {0: ("CTRY", "DE", 0.7, [("AT", 0.2)], "v2"), 3: ("CTRY", "FR", 0.0, None, None)}


def test_the_registered_vote_is_won_by_a_second_alternative_somewhere(spark, sf_dir):
    ranks = {r["rank"] for r in ingest_queries.e6_alternatives(spark, sf_dir).select("rank").distinct().collect()}
    assert 2 in ranks
    assert oracle.difference(ingest_queries.e6_alternatives(spark, sf_dir), queries.ORACLES["e6_alternatives"], sf_dir) is None
