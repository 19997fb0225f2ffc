"""Queue, backfill by ranges, results by day, quantile sketches, watch lists."""

import json
import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from test_streaming import decide_all
from wayfold.operators import decide, patterns, quantiles
from wayfold.sources import backfill, queue, sinks
from wayfold.streaming import enrich as stream

# The queue


def message(k):
    return json.dumps({"rawAddress": f"{k} Road, Town {k}", "countryHint": "GB"}), f"c{k}"


def test_queue_numbers_and_purge(tmp_path):
    path = str(tmp_path / "q")
    assert queue.end(path) == 0
    assert [queue.publish(path, [message(k) for k in range(n)]) for n in (3, 0, 2, 4)] == [3, 3, 5, 9]
    r = queue.QueueReader({"path": path, "most": "4"})
    assert (r.initialOffset(), r.latestOffset()) == ({"next": 0}, {"next": 4})
    rows = [row for p in r.partitions({"next": 2}, {"next": 7}) for row in r.read(p)]
    assert [x[2] for x in rows] == [2, 3, 4, 5, 6] and rows[0][1] == "c2" and rows[1][1] == "c0"
    r.commit({"next": 5})
    r.commit({"next": 4})  # a late commit does not move back
    assert queue.committed(path, "default") == 5 and queue.purge(path) == 2 and queue.end(path) == 9
    with pytest.raises(RuntimeError):
        r.partitions({"next": 2}, {"next": 7})


def test_queue_survives_a_stop_between_write_and_commit(spark, tmp_path):
    """The second batch writes and then fails; after the restart nothing is lost and nothing is there twice."""
    path, store, check = (str(tmp_path / x) for x in ("q", "out", "check"))
    queue.publish(path, [message(k) for k in range(5)])
    queue.publish(path, [(message(k)[0], f"again-{k}") for k in range(3, 9)])  # two addresses again

    def run(fail_at):
        def work(df, n):
            stream.process(df, n, store, decide_all, "RABBITMQ")
            if n == fail_at:
                raise RuntimeError("stopped here")

        q = queue.stream(spark, path, "a", 4).writeStream.option("checkpointLocation", check).foreachBatch(work).trigger(processingTime="100 milliseconds").start()
        try:
            if fail_at is None:
                q.processAllAvailable()
            else:
                with pytest.raises(Exception, match="stopped here"):
                    q.awaitTermination(120)
        finally:
            q.stop()

    run(1)
    assert queue.committed(path, "a") <= 4
    assert stream.stored_results(spark, store).where("batch = 1").count() > 0
    run(None)
    got = stream.stored_results(spark, store).collect()
    assert len(got) == len({r.idem_key for r in got}) == 9
    assert sorted(r.source_channel for r in got) == ["RABBITMQ"] * 9
    assert spark.read.parquet(store + "/duplicates").count() == 2
    queue.publish(path, [message(20)])
    run(None)
    assert stream.stored_results(spark, store).count() == 10


# Backfill


@pytest.fixture
def legacy(tmp_path):
    path = str(tmp_path / "legacy.db")
    db = sqlite3.connect(path)
    db.execute("create table address (party_id integer, address_line_1 text, country_code text)")
    db.executemany("insert into address values (?, ?, ?)", [(k * 3, f"{k} Road", "GB" if k % 2 else None) for k in range(1000)])
    db.commit()
    db.close()
    return {"database": path, "table": "address", "columns": "party_id long, address_line_1 string, country_code string"}


def test_source_plans_ranges_and_takes_filters(spark, legacy):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    backfill.legacy(spark, **legacy)
    load = spark.read.format("legacy_ranges").options(width="500", **legacy).load
    assert load().count() == 1000 and load().rdd.getNumPartitions() == 6
    some = load().where("party_id >= 600 and party_id < 1200 and country_code = 'GB'")
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r.party_id for r in some.collect()) == [k * 3 for k in range(200, 400) if k % 2]
    assert load().where("party_id in (3, 4, 2997)").count() == 2 and load().where("party_id > 99999").count() == 0
    r = backfill.LegacyReader({"database": "x", "table": "t"}, spark.range(1).selectExpr("id as party_id").schema, backfill.connect)
    eq = backfill.EqualTo(("party_id",), 7)
    other = backfill.EqualTo(("country_code",), "GB")
    assert list(r.pushFilters([eq, other])) == [other] and (r.low, r.high) == (7, 7)
    with pytest.raises(ValueError):
        backfill.LegacyReader({"database": "x", "table": "t; drop"}, spark.range(1).schema, backfill.connect)


def test_stopped_backfill_goes_on_with_the_ranges_left(spark, legacy, tmp_path):
    store = str(tmp_path / "run")
    read = backfill.legacy(spark, **legacy)
    asked = []

    def noted(own):
        asked.extend(own)
        return read(own)

    planned = backfill.ranges(0, 2997, 250)
    work = lambda rows: rows.withColumn("out", F.upper("address_line_1"))
    assert backfill.run(spark, noted, "party_id", planned, store, work, wave=3, stop_after=2) == 6

    def broken(rows):
        raise RuntimeError("stopped here")

    with pytest.raises(RuntimeError):
        backfill.run(spark, noted, "party_id", planned, store, broken, wave=3)
    # a range that was written but not marked is done again, in place
    work(read([(1500, 1749)])).withColumn("range", F.lit(1500).cast("long")).write.mode("append").partitionBy("range").parquet(store + "/results")
    asked.clear()
    assert backfill.run(spark, noted, "party_id", planned, store, work, wave=5) == 6
    assert sorted(asked) == planned[6:]
    got = backfill.results(spark, store)
    assert got.count() == 1000 == got.select("party_id").distinct().count()
    assert sorted(backfill.finished(spark, store)) == planned and backfill.run(spark, noted, "party_id", planned, store, work) == 0
    assert backfill.ranges(None, None, 10) == [] and backfill.run(spark, noted, "party_id", [], str(tmp_path / "none"), work) == 0


def test_a_range_is_one_file_however_many_tasks_read_it(spark, tmp_path):
    store = str(tmp_path / "run")
    rows = spark.range(1000).repartition(8)
    planned = backfill.ranges(0, 1199, 100)
    assert backfill.run(spark, backfill.between(rows, "id"), "id", planned, store, lambda x: x, wave=5) == 12
    assert len(list((tmp_path / "run" / "results").rglob("*.parquet"))) == 10
    marked = spark.read.parquet(f"{store}/finished").collect()
    assert sorted((r.low, r.high, r.n_rows) for r in marked) == [(k, k + 99, 100 if k < 1000 else 0) for k in range(0, 1200, 100)]


# Results by day


def test_a_day_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 7200).alias("at"))
    sinks.write_days(rows, path, "at")
    sinks.write_days(rows.where("id < 12"), path, "at")
    sinks.write_days(rows.where("id between 24 and 35").withColumn("id", F.col("id") + 1000), path, "at")
    got = sorted(r.id for r in spark.read.parquet(path).collect())
    assert got == sorted([*range(24), *range(36, 100), *range(1024, 1036)])


# Quantiles


def test_percentiles_are_within_the_stated_error(spark):
    rng = random.Random(1)
    rows = [(g, math.exp(rng.gauss(3, 2)) * (1 if rng.random() > 0.05 else 0)) for g in range(3) for _ in range(2000 * g + 1)] + [(7, None), (8, -1.0)]
    df = spark.createDataFrame(rows, "g int, v double").withColumn("at", F.timestamp_seconds(F.monotonically_increasing_id() % 500_000))
    got = {r.g: r for r in quantiles.percentiles(quantiles.merged(quantiles.hourly(df, "at", "v", "g"), "g"), "g").collect()}
    assert set(got) == {0, 1, 2, 8} and got[8].p50 == 0
    for g in range(3):
        own = sorted(v for k, v in rows if k == g)
        assert got[g].n == len(own)
        for p in quantiles.PERCENTS:
            exact = own[-(-p * len(own) // 100) - 1]
            assert abs(got[g][f"p{p}"] - exact) <= quantiles.ERROR * exact + 1e-6
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), "v", "g"), "g").count() == 0


# Watch lists


def test_mandatory_literals_stand_in_every_match():
    cases = {
        r"BANK\s+MELLI": ["BANK", "MELLI"], r"\bIRGC\b": ["IRGC"], "abc?d": [], "abcd?e": ["ABC"], "abc+d": ["ABC"], "xabc*": ["XAB"], "abcd{0,2}x": ["ABC"], "abcd{2}xyz": ["ABCD", "XYZ"],
        "one|two": [], "(one|two)three": ["THREE"], "[abc]def": ["DEF"], r"a\.bc": ["A.BC"], r"no\d\dyes": ["YES"], "(?:road)? street": [" STREET"], r"\Qabcdef\E": [], "(?x)abc def": [], "ab": [], "": [], r"\p{L}abcd": [], "café noir": [" NOIR", "CAF"], "[]abc]def": ["DEF"], "(abc": [],
    }
    for p, want in cases.items():
        assert patterns.mandatory(p) == sorted(want), p
    assert patterns.mandatory(None) == []


def test_five_thousand_patterns_equal_each_tried_on_each(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    forms = (r"\b{}\b", r"{}\s+(?:x|y)", "[ab]{}", "{}.?z", "(?:{}|qq)", r"{}\d*")
    listed = [(k, rng.choice(forms).format(rng.choice(words))) for k in range(5000)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(6)).title()) for k in range(60)] + [(60, None), (61, ""), (62, "ab")]
    p = spark.createDataFrame(listed + [(5000, None)], "pattern_id int, pattern string")
    t = spark.createDataFrame(texts, "request_id int, raw string")
    got = sorted(tuple(r) for r in patterns.hits(t, p).collect())
    want = sorted((i, k) for k, x in listed for c in [re.compile(x, re.IGNORECASE)] for i, text in texts if text and c.search(text.upper()))
    assert got == want and len(got) > 100
    assert 0 < sum(not patterns.mandatory(x) for _, x in listed) < 5000


def test_watch_lists_of_numbers_try_few_patterns(spark, monkeypatch):
    """Of thousands of patterns that differ in a number only, a text meets few; a list over the limit of broadcasts takes one pass."""
    shapes = (r"\bCustomer#0*{}\b", r"CLERK\s+{}\s+desk", r"NO\. ?{}X", r"gate {}\b.*north")
    p = spark.createDataFrame([(k, shapes[k % 4].format(k)) for k in range(3000)], "pattern_id int, pattern string")
    said = ("deliver to customer#000{}, Gate {} North", "clerk \t{}  desk é{}é", "Street no.{}x, gate {}north", "gate {}: to the north{}")
    texts = [(k, said[k % 4].format(k, k + 1)) for k in range(2000)]
    monkeypatch.setattr(patterns, "LISTED", 100)
    t = spark.createDataFrame(texts, "request_id int, raw string")
    found = patterns.hits(t, p)
    compiled = [(k, re.compile(shapes[k % 4].format(k), re.IGNORECASE)) for k in range(3000)]
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, k) for i, x in texts for k, c in compiled if str(k) in x and c.search(x.upper()))
    own = patterns.index(p).where("gram is not null")
    bits = spark.sparkContext.broadcast(patterns._filter(own, own.count()))
    met = patterns._cut(t.select("request_id", F.upper("raw").alias("_text")), "request_id", bits).join(own, "gram").count()
    assert met < 20 * len(texts)


def test_watch_lists_in_blocks_and_in_the_rules(spark, monkeypatch):
    monkeypatch.setattr(patterns, "LISTED", 2)
    monkeypatch.setattr(patterns, "BLOCK", 2)
    p = spark.createDataFrame([(k, x) for k, x in enumerate(("melli", "irgc", "saderat", r"x\d", r"y\d", r"z\d", "melli bank"))], "pattern_id int, pattern string")
    t = spark.createDataFrame([(1, "Bank MELLI x1 z2"), (2, "plain"), (3, "irgc y4, Saderat"), (4, None)], "request_id int, raw string")
    rows = {r.request_id: (r.watched, r.watch_hits) for r in patterns.watched(t, p).collect()}
    assert rows == {1: (True, [0, 3, 5]), 2: (False, None), 3: (True, [1, 2, 4]), 4: (False, None)}
    assert patterns.hits(t, p.limit(0)).count() == 0 and patterns.hits(t.limit(0), p).count() == 0
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<value:string,confidence:double,merge_strategy:string>>"))
    ruled = patterns.watched(t, p).withColumns({"fields": empty, "overall_confidence": F.lit(1.0), "country_hint": F.lit("GB"), "outcome": F.lit("SUCCESS")})
    said = {r.request_id: "SANCTIONS_PATTERN_MATCH" in r.reasons for r in decide.compliance(ruled, decide.COMPLIANCE | {"watched": "watched"}).collect()}
    assert said == {1: True, 2: False, 3: True, 4: False}


def test_dispatched_requests_are_decided_once(spark, sf_dir):
    """The filter on the decision is not moved below the columns that make it, where they would be made again."""
    from wayfold.plans import config as own
    from wayfold.plans.queries import _decided

    rows = _decided(spark, sf_dir, config=own.COMPLIANCE | {"shadow": False}).withColumn("correlation_id", F.col("request_id").cast("string"))
    plan = sinks.dispatches(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "SANCTIONS_PATTERN_MATCH" in line]
    assert sinks.dispatches(rows).count() == rows.where("decision <> 'BYPASS'").count() > 0
