"""Streams: once a key across batches and restarts, late duplicates, dead letters, live counts."""

import json
import time

from pyspark.sql import functions as F

from wayfold.operators import decide, dedup, merge
from wayfold.plans import enrich as plan
from wayfold.sources import structurers
from wayfold.streaming import enrich as stream
from wayfold.streaming import store as table


def decide_all(requests):
    """Comma-split candidates through the batch plan."""
    cands = structurers.union_all(structurers.comma_parts(requests), order=("stub",)).withColumn("confidence", F.col("raw_confidence"))
    fields = merge.assemble(merge.vote(cands))
    counts = {c: F.lit(0).cast("long") for c in ("agreements", "disagreements", "source_count")}
    out = requests.join(fields, "request_id", "left").withColumns(counts | {"flagged_fields": F.array().cast("array<string>"), "weights": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))})
    return plan.decided(out.withColumn("overall_confidence", decide.overall_confidence()))


def drop(folder, name, rows):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))


def run(spark, folder, store):
    q = stream.start(stream.files(spark, str(folder)), str(store / "out"), str(store / "check"), decide_all).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_one_result_a_key(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    drop(inbox, "a.txt", [{"rawAddress": "London, 1 Main St", "countryHint": "GB"}, {"rawAddress": "LONDON,  1 main st", "countryHint": "gb"}, "{broken", {"rawAddress": " "}])
    run(spark, inbox, tmp_path)
    drop(inbox, "b.txt", [{"rawAddress": "london, 1 main st", "countryHint": "GB"}, {"rawAddress": "Paris", "countryHint": "FR"}])
    run(spark, inbox, tmp_path)  # a restart from the checkpoint
    results = stream.stored_results(spark, str(tmp_path / "out"))
    assert results.count() == results.select("idem_key").distinct().count() == 2
    assert stream.stored_keys(spark, str(tmp_path / "out")).count() == 2
    assert {r.reject_reason for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()} == {"MALFORMED", "BLANK_ADDRESS"}
    # the repeat of the first batch and the late one of the second get the stored result
    stored = {r.idem_key: r for r in results.collect()}
    late = spark.read.parquet(str(tmp_path / "out/duplicates")).collect()
    assert sorted(r.batch for r in late) == [0, 1] and all(stored[r.idem_key].result_id == r.result_id and r.is_duplicate for r in late)
    assert {r.outcome for r in late} <= {"SUCCESS", "REQUIRES_REVIEW"}
    # replaying a batch replaces its own output
    batch = spark.read.text(str(inbox / "b.txt")).withColumn("timestamp", F.current_timestamp())
    stream.process(batch, 1, str(tmp_path / "out"), decide_all)
    assert stream.stored_results(spark, str(tmp_path / "out")).count() == 2
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "out/duplicates")).collect()) == [0, 1]


def failing(requests):
    """Decisions of which ``never`` fails for good, ``twice`` at its first attempt, ``wrong`` for a lasting reason."""
    said = F.when(F.col("raw").startswith("never"), "NETWORK").when(F.col("raw").startswith("twice") & (F.col("attempt") < 2), "TIMEOUT").when(F.col("raw").startswith("wrong"), "VALIDATION")
    return decide_all(requests).withColumn("error", said)


def batch_of(spark, *raws):
    return spark.createDataFrame([(json.dumps({"rawAddress": r, "countryHint": "GB"}), f"c{k}-{r}") for k, r in enumerate(raws)], "value string, correlation_header string").withColumn("timestamp", F.current_timestamp())


def said(spark, store, what):
    return sorted((r.correlation_id, r.batch) for r in spark.read.parquet(f"{store}/{what}").collect())


def test_repeats_of_a_failed_request_are_not_lost(spark, tmp_path):
    """Two requests of a key, the first try fails: both wait, one gets the result and the other is answered from it."""
    store = str(tmp_path / "out")
    stream.process(batch_of(spark, "twice, 1 Road", "TWICE,  1 road", "wrong, 2 Road", "wrong,  2 Road", "fine, 3 Road", "fine,  3 Road"), 0, store, lambda r: failing(r.withColumn("raw", F.lower("raw"))))
    assert [c for c, _ in said(spark, store, "retry")] == ["c0-twice, 1 Road", "c1-TWICE,  1 road"]
    assert [c for c, _ in said(spark, store, "dead")] == ["c2-wrong, 2 Road", "c3-wrong,  2 Road"]
    stream.process(batch_of(spark), 1, store, lambda r: failing(r.withColumn("raw", F.lower("raw"))))
    by = {r.correlation_id: r for r in stream.stored_results(spark, store).collect()}
    answers = {r.correlation_id: r.result_id for r in spark.read.parquet(store + "/duplicates").collect()}
    assert len(by) == 2 and len(answers) == 2 and not by.keys() & answers.keys()
    assert set(by) | set(answers) == {"c0-twice, 1 Road", "c1-TWICE,  1 road", "c4-fine, 3 Road", "c5-fine,  3 Road"}
    assert {by[c].result_id for c in by} == set(answers.values())
    assert spark.read.parquet(store + "/retry/batch=1").count() == 0


def test_a_replay_keeps_what_the_first_run_stored(spark, tmp_path):
    """A batch whose first run stored some results and whose replay succeeds with the others."""
    store = str(tmp_path / "out")
    raws = [f"twice, {k} Road" for k in range(3)] + [f"fine, {k} Road" for k in range(40)]
    stream.process(batch_of(spark, *raws), 0, store, failing)
    first = {r.idem_key: r for r in stream.stored_results(spark, store).collect()}
    assert len(first) == 40
    stream.process(batch_of(spark, *raws), 0, store, decide_all)
    again = {r.idem_key: r for r in stream.stored_results(spark, store).collect()}
    assert len(again) == 43 == stream.stored_results(spark, store).count() and all(again[k] == first[k] for k in first)
    assert spark.read.parquet(store + "/retry").count() == 0 and spark.read.parquet(store + "/duplicates").count() == 0


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    store = str(tmp_path / "out")
    stream.process(batch_of(spark, *(f"fine, {k} Road" for k in range(60))), 0, store, decide_all)
    keyed = dedup.with_key(spark.createDataFrame([("fine, 7 Road", "GB"), ("new, 7 Road", "GB")], "raw string, country_hint string"))
    found = table.lookup(keyed, store + "/results")
    own = {r.b for r in keyed.select(table.bucket().alias("b")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in found.inputFiles()} <= own and found.count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(idem_key" in plan and "idem_key" in plan
    assert len(table.spans(spark, store + "/results")) > 50 >= len(table.spans(spark, store + "/results", sorted(own)))


def test_large_batches_join_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "LISTED", 3)
    store = str(tmp_path / "out")
    for k in (0, 1):
        stream.process(batch_of(spark, *(f"fine, {j} Road" for j in range(8))), k, store, decide_all)
    assert stream.stored_results(spark, store).count() == 8 and spark.read.parquet(store + "/duplicates").count() == 8


def test_spans_are_merged_and_a_half_done_merge_shows_each_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "BUCKETS", 2)
    monkeypatch.setattr(table, "FANOUT", 4)
    path = str(tmp_path / "results")
    schema = table.SCHEMA.replace(", batch long", "")
    for k in range(6):
        rows = [(j, f"key{k}-{j}", "c", "KAFKA", "GB", "{}", "{}", None, "N", "SUCCESS", None) for j in range(5)]
        table.write(spark.createDataFrame(rows, schema), path, k)
    removed = []
    monkeypatch.setattr(table, "remove", lambda spark, p: removed.append(p))  # stops before the old spans go
    assert table.compact(spark, path, 5, fanout=4) == 2
    assert table.read(spark, path).count() == 30 and len(removed) == 10
    monkeypatch.undo()
    monkeypatch.setattr(table, "BUCKETS", 2)
    assert table.compact(spark, path, 5, fanout=4) == 0  # what is covered goes now
    assert table.read(spark, path).count() == 30 and len(table.spans(spark, path)) == 4
    assert {(s.first, s.last) for s in table.spans(spark, path)} == {(0, 4), (5, 5)}


def test_a_key_is_free_again_after_its_retention(spark, tmp_path):
    store = str(tmp_path / "out")
    old = batch_of(spark, "fine, 1 Road").withColumn("timestamp", F.expr("timestamp'2024-01-01 00:00:00'"))
    at = lambda s: F.lit(s).cast("timestamp")
    stream.process(old, 0, store, decide_all, days=30)
    stream.process(batch_of(spark, "fine, 1 Road"), 1, store, decide_all, days=30, now=at("2024-01-20 00:00:00"))
    assert stream.stored_results(spark, store).count() == 1
    stream.process(batch_of(spark, "fine, 1 Road"), 2, store, decide_all, days=30, now=at("2024-02-20 00:00:00"))
    assert stream.stored_results(spark, store).count() == 2


def test_retries_run_on_time_with_an_empty_inbox(spark, tmp_path):
    """Three tries at least a second apart, without a further message."""
    inbox, seen = tmp_path / "in", tmp_path / "seen"
    inbox.mkdir()
    drop(inbox, "a.txt", [{"rawAddress": "never, 1 Road", "countryHint": "GB"}, {"rawAddress": "twice, 2 Road", "countryHint": "GB"}])

    def noted(requests):
        requests.select("raw", "attempt", F.current_timestamp().alias("at")).write.mode("append").parquet(str(seen))
        return failing(requests)

    store = str(tmp_path / "out")
    source = stream.with_ticks(stream.files(spark, str(inbox)), 5)
    q = stream.start(source, store, str(tmp_path / "check"), noted, delay=1.0).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 120
        while time.time() < end and not (table.exists(spark, store + "/dead") and spark.read.schema("raw string").parquet(store + "/dead").count()):
            assert q.isActive, q.exception()
            time.sleep(0.5)
    finally:
        q.stop()
    tries = {}
    for r in spark.read.parquet(str(seen)).collect():
        tries.setdefault(r.raw.split(",")[0], []).append((r.attempt, r.at))
    assert [a for a, _ in sorted(tries["never"])] == [1, 2, 3] and [a for a, _ in sorted(tries["twice"])] == [1, 2]
    for own in tries.values():
        times = [t for _, t in sorted(own)]
        assert all((b - a).total_seconds() >= 1 for a, b in zip(times, times[1:], strict=False))
    assert stream.stored_results(spark, store).count() == 1


def test_failures_are_read_again_until_their_attempts_are_used_up(spark, tmp_path):
    """One request fails for good, one passes at its second attempt, one fails for a lasting reason."""
    store = str(tmp_path / "out")

    def batch(*raws):
        return spark.createDataFrame([(json.dumps({"rawAddress": r, "countryHint": "GB"}),) for r in raws], "value string").withColumn("timestamp", F.current_timestamp())

    stream.process(batch("never, 1 Road", "twice, 2 Road", "wrong, 3 Road", "fine, 4 Road"), 0, store, failing)
    assert {r.raw.split(",")[0] for r in spark.read.parquet(store + "/retry").where("batch = 0").collect()} == {"never", "twice"}
    for k in (1, 2, 3):
        stream.process(batch(), k, store, failing)
    dead = {r.raw.split(",")[0]: (r.reject_reason, r.attempt, r.batch) for r in spark.read.parquet(store + "/dead").collect()}
    assert dead == {"wrong": ("VALIDATION", 1, 0), "never": ("NETWORK", 3, 2)}
    kept = stream.stored_results(spark, store).collect()
    assert sorted(r.batch for r in kept) == [0, 1] and stream.stored_keys(spark, store).count() == 2


def test_stream_equals_batch_for_live_counts(spark, tmp_path):
    e = spark.range(50).select(F.timestamp_seconds(F.col("id") * 17).alias("ts"), F.lit("HTTP").alias("source_channel"), F.lit("SUCCESS").alias("outcome"), F.col("id").alias("latency_ms"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = stream.live_metrics(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, stream.live_metrics(spark.read.parquet(str(tmp_path / "e"))).collect()))


def test_redelivery(spark):
    df = spark.createDataFrame([(1, 1), (2, 3)], "id int, attempt int")
    again, dead = stream.redeliver(df)
    assert ([r.id for r in again.collect()], [r.id for r in dead.collect()]) == ([1], [2])


def test_repeats_within_the_watermark_are_filtered(spark, tmp_path):
    rows = [("a", 0), ("a", 5), ("b", 6)]
    spark.createDataFrame(rows, "idem_key string, s long").select("idem_key", F.timestamp_seconds("s").alias("arrival_ts")).coalesce(1).write.parquet(str(tmp_path / "r"))
    source = spark.readStream.schema("idem_key string, arrival_ts timestamp").parquet(str(tmp_path / "r"))
    q = stream.recent_only(source).writeStream.format("memory").queryName("recent").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.idem_key for r in spark.table("recent").collect()) == ["a", "b"]
