import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import ADD, EXECUTE, MAX, QUOTE, TRADE
from tests.test_rules import BLUEPRINT, EXAMPLE, GOLDEN
from tests.test_sources import CONFIG, HEAD, RAW
from tickloom.operators import conditions as C, transform as X
from tickloom.operators.deadletter import DeadLetterConfig, quarantine, source_location
from tickloom.operators.documents import check_document, event_json, find_credential_keys
from tickloom.operators.report import (
    duration_average, event_rate, in_source_order, latest_per_key, recent_dead_letters, run_outcome,
)
from tickloom.operators.validate import validate_events
from tickloom.plans.run import classified, read_capture_input, read_csv_input, read_jsonl_input, run
from tickloom.sinks.files import read_dead_letters, write_csv, write_jsonl
from tickloom.sinks.publish import current_path, publish, remove_unpublished, versioned, versions
from tickloom.streaming.pipeline import (
    batch_writer, live_counters, read_event_stream, start_counter_stream, start_file_streams, stream_counters,
    stream_states,
)


def write(path, data):
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def text(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text().splitlines())


def numbers(report):
    return tuple(report.counters[k] for k in ("received", "parsed", "normalized", "filtered", "emitted", "failed"))


def test_jsonl_run_reproduces_the_golden_line(spark, tmp_path):
    inputs = read_jsonl_input(spark, write(tmp_path / "in.jsonl", ADD + "\n" + TRADE + "\n"))
    report = run(inputs, str(tmp_path / "out"), blueprint=BLUEPRINT)
    assert text(tmp_path / "out") == [GOLDEN]
    assert numbers(report) == (2, 2, 2, 0, 1, 1) and report.outcome == "COMPLETED"
    assert report.failures[0]["source_location"].endswith(":line 2$.what.of")


def test_csv_run(spark, tmp_path):
    p = write(tmp_path / "in.csv", HEAD + f'5,"QUIX","XTST","314.18",9,S,x\n{MAX},"ZORB","XTST","187.25",730,B,"a, b"\n')
    columns = [("symbol", "instrument.symbol"), ("timestamp", "metadata.exchangeTimestamp"), ("price", "payload.price"),
               ("side", "payload.aggressorSide"), ("none", "payload.bid.price")]
    report = run(read_csv_input(spark, p, CONFIG), str(tmp_path / "out"), csv=columns)
    assert text(tmp_path / "out") == ["QUIX,5,314.18,SELL,", f"ZORB,{MAX},187.25,BUY,", "symbol,timestamp,price,side,none"]
    assert numbers(report) == (2, 2, 2, 0, 2, 0)
    p = write(tmp_path / "bad.csv", HEAD + "1,A,X,12.345,1,B\n2,A,X,1.00,1,B\n")
    assert numbers(run(read_csv_input(spark, p, CONFIG), str(tmp_path / "out2"))) == (2, 1, 1, 0, 1, 1)


def test_capture_run(spark, tmp_path):
    first, third = (RAW[k][:3] + n.to_bytes(8, "big") + RAW[k][11:] for k, n in (("add", 1), ("execute", 3)))
    p = write(tmp_path / "c.bin", first + third + third + b"\x00\x01Q" + b"\x00\x00")
    report = run(read_capture_input(spark, p, "sim", "xtst"), str(tmp_path / "out"))
    assert numbers(report) == (5, 4, 3, 0, 3, 2)
    assert (report.sequence_gap_count, report.duplicate_count) == (1, 1)
    assert [(r["stage"], r["detail"].split(":")[0]) for r in report.failures] == [
        ("NORMALIZE", "UNSUPPORTED_MESSAGE_TYPE"), ("PARSE", "encoded length must be between 1 and 65535")]


def test_demo_counts(spark, tmp_path):
    def frame(n):
        return RAW["add"][:3] + n.to_bytes(8, "big") + RAW["add"][11:]

    p = write(tmp_path / "c.bin", b"".join(frame(n) for n in range(1, 10001)) + b"\x00\x00")
    report = run(read_capture_input(spark, p, "sim", "xtst"), str(tmp_path / "out"))
    assert numbers(report) == (10001, 10000, 10000, 0, 10000, 1) and report.sequence_gap_count == 0


def test_quarantine_run(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", '{"password":"do-not-retain"}\n' + ADD + "\n")
    ids = []
    for attempt in range(2):
        config = DeadLetterConfig(include_payload=True, max_bytes=64)
        letters = tmp_path / f"dead{attempt}"
        report = run(read_jsonl_input(spark, p), str(tmp_path / "out"), dead_letter_path=str(letters), config=config)
        assert numbers(report) == (2, 1, 1, 0, 1, 1) and report.outcome == "COMPLETED"
        raw = "\n".join(text(letters))
        assert "do-not-retain" not in raw and "[REDACTED]" in raw
        rows = read_dead_letters(spark, str(letters)).collect()
        assert len(rows) == 1 and rows[0]["category"] == "MALFORMED_INPUT" and rows[0]["stage"] == "PARSE"
        assert rows[0]["sourceLocation"].endswith("in.jsonl:line 1") and rows[0]["eventId"] is None
        assert list(json.loads(raw)) == sorted(json.loads(raw))
        ids.append(rows[0]["failureId"])
    assert ids[0] == ids[1]


def test_policies(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "{}\n" + ADD + "\n")
    skip = run(read_jsonl_input(spark, p), str(tmp_path / "a"), config=DeadLetterConfig("SKIP"), dead_letter_path=str(tmp_path / "d"))
    assert numbers(skip) == (2, 1, 1, 0, 1, 1) and skip.outcome == "COMPLETED" and not (tmp_path / "d").exists()
    stop = run(read_jsonl_input(spark, p), str(tmp_path / "b"), config=DeadLetterConfig("FAIL_FAST"))
    assert numbers(stop) == (1, 0, 0, 0, 0, 1) and stop.outcome == "FAILED" and not (tmp_path / "b").exists()
    with pytest.raises(ValueError):
        DeadLetterConfig("NOPE")


def test_counters_add_up_with_rules(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "\n".join([ADD, EXECUTE, TRADE, "x", TRADE.replace('"quantity": 9,', '"quantity": 95,')]))
    report = run(read_jsonl_input(spark, p), str(tmp_path / "out"), rules=EXAMPLE, sample=2)
    assert numbers(report) == (5, 4, 4, 1, 1, 3)
    assert len(report.failures) == 2 and report.suppressed == 1
    c = report.counters
    assert c["received"] == c["emitted"] + c["filtered"] + c["failed"]


def test_publish_keeps_the_old_output_on_failure(spark, tmp_path):
    out = tmp_path / "out"
    write_jsonl(spark.createDataFrame([(1,)], "a long"), str(out))
    with pytest.raises(Exception):
        write_jsonl(spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("a")), str(out))
    assert text(out) == ['{"a":1}'] and [p.name for p in tmp_path.iterdir()] == ["out"]
    publish(spark, str(out), lambda to: spark.range(0).selectExpr("cast(id as string)").write.text(to))
    assert text(out) == []


def test_a_run_scans_its_lines_once(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", ADD + "\n")
    plan = classified(read_jsonl_input(spark, p), rules=EXAMPLE, blueprint=BLUEPRINT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan


def test_line_numbers_over_blocks_and_blank_lines(spark, tmp_path):
    lines = [ADD, "", "bad", TRADE, "  "] * 400
    p = write(tmp_path / "in.jsonl", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        report = run(read_jsonl_input(spark, p), str(tmp_path / "out"), sample=5000, work=str(tmp_path / "work"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert numbers(report) == (2000, 800, 800, 0, 800, 1200) and report.suppressed == 0
    assert [r["source_location"].rsplit(" ", 1)[1] for r in report.failures] == [
        str(i) for i, line in enumerate(lines, 1) if line not in (ADD, TRADE)]
    assert len(text(tmp_path / "out")) == 800 and not (tmp_path / "work").exists()


def test_empty_input_publishes_an_empty_output(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "")
    report = run(read_jsonl_input(spark, p), str(tmp_path / "out"), config=DeadLetterConfig("FAIL_FAST"))
    assert numbers(report) == (0,) * 6 and report.outcome == "COMPLETED" and text(tmp_path / "out") == []


def test_versions_replace_each_other_and_stay_readable(spark, tmp_path):
    out = str(tmp_path / "out")
    assert current_path(spark, out) is None and versions(spark, out) == []
    seen = []
    for i in range(11):
        write_jsonl(spark.createDataFrame([(i,)], "a long"), out, versioned)
        seen.append(current_path(spark, out))
        assert [spark.read.text(p).first()[0] for p in seen[-2:]] == [f'{{"a":{n}}}' for n in range(max(i - 1, 0), i + 1)]
    assert len(versions(spark, out)) == 2 and len(list((tmp_path / "out" / "versions").iterdir())) == 2
    with pytest.raises(Exception):
        write_jsonl(spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("a")), out, versioned)
    assert current_path(spark, out) == seen[-1] and len(list((tmp_path / "out" / "versions").iterdir())) == 2
    lost = versioned(spark, out)  # a driver that ends before its commit
    spark.range(3).selectExpr("cast(id as string)").write.text(lost.folder)
    assert current_path(spark, out) == seen[-1]
    assert remove_unpublished(spark, out, 3_600_000) == 0 and remove_unpublished(spark, out, 0) == 1
    assert current_path(spark, out) == seen[-1] and spark.read.text(seen[-1]).count() == 1


def test_two_writers_of_one_number_leave_one_current(spark, tmp_path):
    out = str(tmp_path / "out")
    first, second = versioned(spark, out), versioned(spark, out)
    for i, staged in enumerate((first, second)):
        spark.createDataFrame([(str(i),)], "value string").write.text(staged.folder)
    second.commit()
    first.commit()
    assert current_path(spark, out) == first.folder and len(versions(spark, out)) == 2


def test_output_that_cannot_be_written(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "{}\n" + ADD + "\n")
    blocked = write(tmp_path / "file", "x")
    report = run(read_jsonl_input(spark, p), blocked + "/out", config=DeadLetterConfig(), dead_letter_path=str(tmp_path / "dead"))
    assert report.outcome == "FAILED" and numbers(report) == (2, 1, 1, 0, 1, 2)
    assert [(r["stage"], r["source_location"]) for r in report.failures][1:] == [("OUTPUT", "output")]
    rows = {r["stage"]: r for r in read_dead_letters(spark, str(tmp_path / "dead")).collect()}
    assert set(rows) == {"PARSE", "OUTPUT"} and rows["OUTPUT"]["retryability"] == "RETRYABLE" and rows["OUTPUT"]["eventId"] is None


def test_dead_letters_that_cannot_be_written_hold_the_output_back(spark, tmp_path):
    p = write(tmp_path / "in.jsonl", "{}\n" + ADD + "\n")
    blocked = write(tmp_path / "file", "x")
    write_jsonl(spark.createDataFrame([(1,)], "a long"), str(tmp_path / "out"))
    report = run(read_jsonl_input(spark, p), str(tmp_path / "out"), config=DeadLetterConfig(), dead_letter_path=blocked + "/dead")
    assert report.outcome == "FAILED" and report.failures[-1]["source_location"] == "dead-letter"
    assert text(tmp_path / "out") == ['{"a":1}'] and sorted(x.name for x in tmp_path.iterdir()) == ["file", "in.jsonl", "out"]


def test_csv_sink_quoting_and_rejects(spark, events, tmp_path):
    df = spark.createDataFrame([("a,b",), (' pad ',), ('q"x',), ("l\nb",), ("",), (None,), ("plain",)], "v string").select(
        F.struct("v").alias("output"))
    write_csv(df.coalesce(1), str(tmp_path / "o"), [("v", "v"), ("w", "v")], header=False)
    raw = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert raw == '"a,b","a,b"\n pad , pad \n"q""x","q""x"\n"l\nb","l\nb"\n,\n,\nplain,plain\n'
    with pytest.raises(ValueError):
        write_csv(events(ADD), str(tmp_path / "x"), [("p", "payload")])


def test_validate_events_and_event_json(spark, events):
    good, bad = validate_events(events(ADD.replace("XTST", "xtst"), TRADE.replace('"SELL"', '"S"'), QUOTE))
    assert sorted(r["metadata"]["venue"] for r in good.collect()) == ["XTST", "XTST"]
    assert [r["_issue"]["reason"] for r in bad.collect()] == ["INVALID_FIELD"]
    df = events(QUOTE)
    doc = df.select(event_json(df).alias("j")).first()["j"]
    assert doc.endswith('"payload":{"bid":{"price":0.5,"quantity":3},"type":"QUOTE"}}') and "receiveTimestamp" not in doc


def test_first_failures_are_found_without_sorting_rows(spark, tmp_path, monkeypatch):
    from tickloom.plans import queries
    from tickloom.plans.run import first_failures, located_failures

    rows = [(f, b, r, s) for f, states in {"a": "GGBGB", "b": "GGGG", "c": "BGGGB"}.items()
            for i, s in enumerate(states) for b, r in [(i // 2, 100 - 10 * (i // 2) + i)]]
    frame = spark.createDataFrame([(f, b, r, None, "", None, None, None, "x" * 9, None, "PARSE_FAILED" if s == "B" else "EMITTED")
                                   for f, b, r, s in rows], "file_path string, __block long, __row long, source_location string, below string, "
                                  "stage string, detail string, event string, source_text string, frame binary, state string")
    assert sorted(map(tuple, first_failures(frame).collect())) == [("a", 1, 92), ("c", 0, 100)]
    assert sorted(r.position for r in located_failures(frame, stop=True).collect()) == [92, 100]
    assert "SortAggregate" not in first_failures(frame)._jdf.queryExecution().executedPlan().toString()
    # Both runs of the query go over the same files.
    made = []
    spark.range(50).selectExpr("id AS event_id", "id % 3 AS user_id", "timestamp'2024-01-01' AS ts", "'view' AS event_type", "1.5D AS value") \
        .write.parquet(str(tmp_path / "events.parquet"))
    plain = queries.event_files
    monkeypatch.setattr(queries, "event_files", lambda *a: made.append(plain(*a)) or made[-1])
    report = dict(queries.run_fail_fast(spark, str(tmp_path)).collect())
    assert len(made) == 1 and report["outcome"] == "FAILED" and report["received"] == "6" and report["failed"] == "5"


def test_fail_fast_letters_fail_the_job(spark):
    df = spark.createDataFrame([("f", "a:line 1", "m")], "failureId string, sourceLocation string, safeMessage string")
    assert quarantine([df, df]).count() == 2 and quarantine([df], "SKIP").count() == 0
    with pytest.raises(Exception, match="run stopped at a:line 1"):
        quarantine([df], "FAIL_FAST").collect()
    assert df.select(source_location(F.lit("p"), "row", F.lit(3), F.lit("$.x"))).first()[0] == "p:row 3$.x"


def test_rates(spark):
    second = 10 ** 9
    rows = [("two", 0, 0), ("two", 2 * second, 9), ("one", 0, 5), ("same", 5, 1), ("same", 5, 3), ("down", 0, 9), ("down", second, 1)]
    rows += [("long", i * second, i if i < 150 else 150 + (i - 150) * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "run string, timestamp_nanos long, received long")
    got = {r["run"]: r["events_per_second"] for r in event_rate(df).collect()}
    assert got == {"two": 4, "one": 0, "same": 0, "down": 0, "long": 3}
    d = spark.createDataFrame([("a", 5), ("a", 4), ("b", None)], "k string, n long")
    assert {r["k"]: r["average"] for r in duration_average(d, "n", ["k"]).collect()} == {"a": 4, "b": 0}


def test_counters_ride_on_an_action(spark):
    from pyspark.sql import Observation

    from tickloom.operators.report import observe_counters, run_counters

    df = spark.createDataFrame([("EMITTED",), ("FILTERED",), ("PARSE_FAILED",), ("NORMALIZE_FAILED",)], "state string")
    seen = Observation("run")
    observe_counters(df, seen).collect()
    want = {"received": 4, "parsed": 3, "normalized": 2, "filtered": 1, "emitted": 1, "failed": 2}
    assert seen.get == want and run_counters(df).first().asDict() == want
    assert run_counters(df, by=["state"]).count() == 4


def test_latest_recent_and_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, rev int, v string")
    assert sorted(tuple(r) for r in latest_per_key(df, ["k"], ["rev"]).collect()) == [("a", 3, "y"), ("b", 2, "z")]
    letters = spark.createDataFrame([("p", f"{i:03d}", f"f{i}") for i in range(70)], "pipelineId string, timestamp string, failureId string")
    got = sorted(r["timestamp"] for r in recent_dead_letters(letters).collect())
    assert got == [f"{i:03d}" for i in range(20, 70)]
    parts = in_source_order(spark.createDataFrame([(s, i) for i in range(50) for s in "ab"], "s string, i int").repartition(4), "s", "i") \
        .rdd.glom().collect()
    assert [r for p in parts for r in p] == sorted((s, i) for i in range(50) for s in "ab")
    n = spark.createDataFrame([(3, 1)], "emitted long, failed long")
    assert run_outcome(n).first()["outcome"] == "COMPLETED" and run_outcome(n, sink_failed=True).first()["outcome"] == "FAILED"


def test_documents(spark):
    docs = ['{"a":{"userPassword":1},"b":[{"x":{"API_KEY":2}},3]}', '{"note":"\\"password\\": x","k":1}', "nope",
            '{"a":[1,{"Token":"secret"}],"credentials":{}}', '{"pass\\u0077ord":1}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r["credential_keys"] for r in find_credential_keys(df, "d").orderBy("i").collect()]
    assert got == [["API_KEY", "userPassword"], [], None, ["Token", "credentials"], ["password"]]
    docs = {'{"$schema":"http://x"}': None, "[]": "document must be a JSON object", "null": "document is required",
            '{"$schema":" "}': "document.$schema is required to identify the JSON Schema dialect", '{"$schema":1}': "document.$schema is required to identify the JSON Schema dialect",
            "{}": "document.$schema is required to identify the JSON Schema dialect"}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    assert [r["document_issue"] for r in check_document(df, "d").orderBy("i").collect()] == list(docs.values())


def test_event_stream_good_rows_and_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", "\n".join([ADD, "bad", TRADE]))
    states = stream_states(read_event_stream(spark, str(tmp_path / "in")), blueprint=BLUEPRINT)
    queries = start_file_streams(states, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp"), "p", "1")
    for q in queries:
        q.awaitTermination()
    assert text(tmp_path / "good") == [GOLDEN]
    stages = sorted(r["stage"] for r in read_dead_letters(spark, str(tmp_path / "dead")).collect())
    assert stages == ["BLUEPRINT", "PARSE"]
    counters = live_counters(queries[0])
    assert (counters["received"], counters["emitted"], counters["failed"]) == (3, 1, 2)


def test_counters_of_more_batches_than_spark_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(12):
        write(tmp_path / "in" / f"{i}.jsonl", "\n".join([ADD, "bad", TRADE]))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        states = stream_states(read_event_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), blueprint=BLUEPRINT)
        query = start_counter_stream(states, str(tmp_path / "states"), str(tmp_path / "cp"))
        query.awaitTermination()
        assert len(query.recentProgress) <= 5
        with pytest.raises(ValueError):
            live_counters(query)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    got = stream_counters(spark, str(tmp_path / "states")).first()
    assert (got["received"], got["emitted"], got["failed"]) == (36, 12, 24)


def test_repeated_batch_replaces_itself(spark, events, tmp_path):
    from tickloom.operators.validate import with_validation

    parsed = with_validation(events(ADD, TRADE.replace("SELL", "X"))).withColumns(
        {"source_text": F.lit("t"), "file_path": F.lit("f"), "source_location": F.lit("f")})
    states = stream_states(parsed, blueprint=BLUEPRINT)
    write_batch = batch_writer(str(tmp_path / "good"), str(tmp_path / "dead"), "p", "1")
    for _ in range(2):
        write_batch(states, 7)
    assert text(tmp_path / "good" / "batch_id=7") == [GOLDEN]
    assert len(text(tmp_path / "dead" / "batch_id=7")) == 1


def test_transform_runs_on_a_stream(spark, events, tmp_path):
    events(ADD, TRADE).write.parquet(str(tmp_path / "in"))
    schema = events(ADD).schema
    out = X.filter_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")),
                          C.comparison("payload.quantity", "GT", C.int64(50)), keep_filtered=False)
    out.select("document", "_status").writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
