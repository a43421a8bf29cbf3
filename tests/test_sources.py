import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import IDS, ADD, CANCEL, EXECUTE, MAX, QUOTE, TRADE
from tickloom.functions.fixed import fd_plain
from tickloom.sources.capture import split_capture, split_errors
from tickloom.sources.csv import CsvConfig, read_trades_csv
from tickloom.sources.frames import decode_columns, decode_frames, normalize_frames
from tickloom.sources.jsonl import FAIL_FAST, read_canonical_jsonl
from tickloom.sources.lines import read_lines, read_summary, with_ordinal


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def counts(events, errors):
    r = read_summary(events, errors).first()
    return r["rows_read"], r["events_produced"], r["errors_reported"]


def test_jsonl_modes(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", "\n".join([
        ADD, "not-json", EXECUTE.replace('"minor": 0', '"minor": 1'), CANCEL.replace(IDS[9][:8], "0" * 8), TRADE]))
    events, errors = read_canonical_jsonl(spark, p)
    assert counts(events, errors) == (5, 2, 3)
    assert [(r["line_number"], r["reason"]) for r in errors.orderBy("line_number").collect()] == [
        (2, "MALFORMED_JSON"), (3, "SCHEMA_VERSION"), (4, "EVENT_ID_MISMATCH")]
    assert events.orderBy("line_number").first()["metadata"]["exchangeTimestamp"] == 1650000000000000500
    assert counts(*read_canonical_jsonl(spark, p, FAIL_FAST)) == (2, 1, 1)


def test_jsonl_reasons(spark, tmp_path):
    def change(text, **kw):
        d = json.loads(text)
        for path, value in kw.items():
            at = d
            *up, leaf = path.split("__")
            for k in up:
                at = at[k]
            if value is ...:
                del at[leaf]
            else:
                at[leaf] = value
        return json.dumps(d)

    cases = [
        ("", "EMPTY_LINE"), ("[1]", "INVALID_FIELD"), ("null", "INVALID_FIELD"), (TRADE + " {}", "MALFORMED_JSON"),
        (TRADE + "]5}", "MALFORMED_JSON"), (TRADE + ",", "MALFORMED_JSON"), (TRADE + "," + TRADE, "MALFORMED_JSON"),
        (change(TRADE, extra=1), "MALFORMED_JSON"), (change(TRADE, metadata__x=1), "MALFORMED_JSON"),
        (change(TRADE, metadata=...), "REQUIRED_FIELD"), (change(TRADE, metadata__venue=""), "REQUIRED_FIELD"),
        (change(TRADE, metadata__sequenceNumber="4"), "MALFORMED_JSON"), (change(TRADE, metadata__sequenceNumber=0), "INVALID_FIELD"),
        (change(TRADE, metadata__receiveTimestamp=None), "REQUIRED_FIELD"), (change(TRADE, instrument=None), "REQUIRED_FIELD"),
        (change(TRADE, instrument__symbol="A B"), "INVALID_FIELD"), (change(TRADE, instrument__symbol="ABCDEFGH "), "INVALID_FIELD"),
        (change(TRADE, payload=5), "INVALID_FIELD"), (change(TRADE, payload__type=5), "INVALID_FIELD"),
        (change(TRADE, payload__type="X"), "UNSUPPORTED_EVENT_TYPE"), (change(TRADE, payload__tradeId=1.5), "INVALID_FIELD"),
        (change(TRADE, payload__tradeId=...), "REQUIRED_FIELD"), (change(TRADE, payload__quantity=4294967296), "INVALID_FIELD"),
        (change(TRADE, payload__price=None), "REQUIRED_FIELD"), (change(TRADE, payload__price__scale=19), "INVALID_FIELD"),
        (change(TRADE, payload__price__x=1), "INVALID_FIELD"), (change(TRADE, payload__orderId=1), "INVALID_FIELD"),
        (change(QUOTE, payload__bid=None), "REQUIRED_FIELD"), (change(QUOTE, payload__bid=...), "REQUIRED_FIELD"),
        (change(QUOTE, payload__bid__quantity=0), "NORMALIZATION_ERROR"), (change(QUOTE, payload__bid__price__scale=19), "NORMALIZATION_ERROR"),
        (change(QUOTE, payload__bid__quantity="1"), "INVALID_FIELD"), (change(QUOTE, payload__ask={"quantity": 1}), "REQUIRED_FIELD"),
        (TRADE, None), (QUOTE, None), (TRADE.replace('"XTST"', '"A", "venue": "xtst"'), None),
        (change(TRADE, payload__aggressorSide=...), None),
    ]
    p = write(tmp_path / "a.jsonl", "\n".join(text for text, _ in cases) + "\n")
    events, errors = read_canonical_jsonl(spark, p)
    got = {r["line_number"]: r["reason"] for r in errors.collect()}
    assert [got.get(i + 1) for i in range(len(cases))] == [reason for _, reason in cases]
    assert {r[0] for r in events.select("metadata.venue").collect()} == {"XTST"}


def test_absent_members_are_not_looked_up_by_path(spark):
    from tickloom.sources.jsonl import parse_event_lines

    def put(text, *path, value):
        doc = json.loads(text)
        inner = doc
        for name in path[:-1]:
            inner = inner[name]
        inner[path[-1]] = value
        return json.dumps(doc)

    level = {"price": {"mantissa": 5, "scale": 1}, "quantity": 3}
    cases = [(ADD, None), (QUOTE, None), (put(QUOTE, "payload", "ask", value=level), None), ("[]", "INVALID_FIELD"), (ADD + ",1", "MALFORMED_JSON"),
             (put(ADD, "payload", value=[1]), "INVALID_FIELD"), (put(ADD, "payload", value={}), "REQUIRED_FIELD"),
             (put(ADD, "metadata", value={}), "REQUIRED_FIELD"), (put(ADD, "metadata", value=None), "REQUIRED_FIELD"),
             (put(ADD, "metadata", "schemaVersion", value=7), "MALFORMED_JSON"), (put(ADD, "metadata", "venue", value={}), "MALFORMED_JSON"),
             (put(ADD, "payload", "price", value=1), "INVALID_FIELD"), (put(ADD, "payload", "price", value={"mantissa": 1}), "REQUIRED_FIELD"),
             (put(QUOTE, "payload", "ask", value=None), "REQUIRED_FIELD"), (put(QUOTE, "payload", "bid", "price", value=[]), "INVALID_FIELD"),
             (put(QUOTE, "payload", "bid", "price", "more", value=1), "INVALID_FIELD"), (put(ADD, "instrument", "more", value={}), "MALFORMED_JSON")]
    parsed = parse_event_lines(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, value string"))
    got = dict(parsed.select("i", "_issue.reason").collect())
    assert [got[i] for i in range(len(cases))] == [reason for _, reason in cases]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "$[0].payload.bid" not in plan and "$[1]" not in plan


def test_line_numbers_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        a = write(tmp_path / "a.txt", "".join(f"{i}\n" for i in range(1, 60001)))
        b = write(tmp_path / "b.txt", "1\n\n3")
        lines = with_ordinal(read_lines(spark, [a, b]))
        assert lines.rdd.getNumPartitions() > 4
        bad = lines.filter((F.col("value") != "") & (F.col("value") != F.col("line_number").cast("string")))
        assert bad.count() == 0 and lines.count() == 60003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CONFIG = CsvConfig(source="csv/desk", timestamp_column="at", symbol_column="code", venue_column="place",
                   decimal_price_column="paid", quantity_column="lots", side_column="way",
                   side_mapping={"B": "BUY", "S": "SELL"}, price_scale=2)
HEAD = "at,code,place,paid,lots,way,remark\n"


def csv(spark, tmp_path, text, config=CONFIG, **kw):
    events, errors = read_trades_csv(spark, write(tmp_path / f"{random.random()}.csv", text), config, **kw)
    good = [(r["row"], r["seq"], r["symbol"], r["p"]) for r in events.select(
        "row", F.col("metadata.sequenceNumber").alias("seq"), "instrument.symbol", fd_plain(F.col("payload.price")).alias("p"))
        .orderBy("row").collect()]
    bad = [(r["row"], r["reason"]) for r in errors.orderBy("row").collect()]
    return good, bad


def test_csv_rows(spark, tmp_path):
    text = HEAD + (f'{MAX},"ZORB","XTST","187.25",730,B,"half ""way""\ndown, so"\n2,B,X,12.345,5,B\n\n3,C,X,1,5,S\r\n'
                   '4,D,X,1,5\n5,E,X,1e1,7,B,n,more\n')
    assert csv(spark, tmp_path, text) == (
        [(2, 1, "ZORB", "187.25"), (6, 4, "C", "1.00"), (8, 6, "E", "10.00")],
        [(4, "INVALID_DECIMAL"), (5, "INVALID_TIMESTAMP"), (7, "MISSING_COLUMN")])


def test_csv_column_reasons_in_order(spark, tmp_path):
    rows = ["-1,A B,/,x,0,Z", "1,A B,/,x,0,Z", "1,AB,/,x,0,Z", "1,AB,X,x,0,Z", "1,AB,X,1,0,Z", "1,AB,X,1,1,Z", "1,AB,X,1,1,B"]
    good, bad = csv(spark, tmp_path, HEAD + "\n".join(rows))
    assert [r for _, r in bad] == ["INVALID_TIMESTAMP", "INVALID_SYMBOL", "INVALID_VENUE", "INVALID_DECIMAL", "INVALID_QUANTITY", "INVALID_SIDE"]
    assert good == [(8, 7, "AB", "1.00")]


def test_csv_syntax_error_ends_the_file(spark, tmp_path):
    for bad_row in ('2,"F"x,X,1,1,B\n', '2,F"x,X,1,1,B\n', '2,"open,X,1,1,B\n'):
        good, bad = csv(spark, tmp_path, HEAD + "1,A,X,1,1,B\n" + bad_row + "3,C,X,1,1,B\n")
        assert good == [(2, 1, "A", "1.00")] and bad == [(3, "MALFORMED_ROW")]


def test_csv_header_and_modes(spark, tmp_path):
    assert csv(spark, tmp_path, "at,code\n1,A\n") == ([], [(1, "MISSING_COLUMN")])
    assert csv(spark, tmp_path, HEAD.replace("remark", "way") + "1,A,X,1,1,B\n") == ([], [(1, "INVALID_CONFIGURATION")])
    assert csv(spark, tmp_path, HEAD + "1,A,X,zz,5,B\n2,A,X,1,5,B\n", mode=FAIL_FAST) == ([], [(2, "INVALID_DECIMAL")])
    assert csv(spark, tmp_path, "") == ([], [])
    plain = CsvConfig(source="s", timestamp_column="0", symbol_column="1", price_mantissa_column="2", quantity_column="3",
                      side_column="4", side_mapping={"b": "BUY"}, constant_venue="xtst", has_header=False, delimiter="|",
                      timestamp_format="ISO_INSTANT", price_scale=3)
    assert csv(spark, tmp_path, "1970-01-01T00:00:01Z|A|1500|3|b\n", plain) == ([(1, 1, "A", "1.500")], [])
    named = CsvConfig(**{**plain.__dict__, "symbol_column": "sym"})
    assert csv(spark, tmp_path, "1970-01-01T00:00:01Z|A|1500|3|b\n", named) == ([], [(1, "INVALID_CONFIGURATION")])


def test_plain_csv_sorts_no_lines_and_checks_headers_once(spark, tmp_path):
    rows = ["1,A,X,1,1,B", '2,"B",X,1,5,B', "3,C,X,1,0,B", '4,"C"x,X,1,5,B', "5,D,X,1,5,B"]
    for text in (HEAD + "\n".join(rows), HEAD + "\r\n".join(rows[:3]), HEAD + '1,"A,X,1,1,B', HEAD + '1,A"B,X,1,1,B\n', "", "\n"):
        assert csv(spark, tmp_path, text, quoted_line_breaks=False) == csv(spark, tmp_path, text)
    events, errors = read_trades_csv(spark, write(tmp_path / "plan.csv", HEAD + "\n".join(rows)), CONFIG, quoted_line_breaks=False)
    for part in (events, errors):
        query = part._jdf.queryExecution()
        assert "SortAggregate" not in query.executedPlan().toString()
        plan = query.optimizedPlan().toString().splitlines()
        checks = [i for i, step in enumerate(plan) if "Filter" in step and "duplicate CSV header" in step]
        assert checks and all(any("CollectMetrics" in step for step in plan[i + 1:i + 3]) for i in checks)


def test_csv_over_many_splits_equals_python(spark, tmp_path):
    import csv as std
    import io

    rng = random.Random(3)
    out = io.StringIO()
    w = std.writer(out, lineterminator="\n")
    w.writerow(HEAD.strip().split(","))
    for i in range(4000):
        w.writerow([i, f"S{i}", "X", f"{i}.25", 1, "B", rng.choice(["", "plain", 'q"uote', "two\nlines", "a,b", '"\n"\n'])])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        good, bad = csv(spark, tmp_path, out.getvalue())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not bad and [(s, sym, p) for _, s, sym, p in good] == [(i + 1, f"S{i}", f"{i}.25") for i in range(4000)]
    lines = [0, *[i for i, c in enumerate(out.getvalue()) if c == "\n"]]
    assert good[-1][0] < len(lines) and good[0][0] == 2


@pytest.mark.parametrize("change", [{"delimiter": '"'}, {"venue_column": None}, {"constant_venue": "X"}, {"price_scale": 19},
                                    {"side_mapping": {}}, {"side_mapping": {"a": "b"}}, {"symbol_column": " "}, {"timestamp_format": "X"}])
def test_csv_config_rejects(change):
    with pytest.raises(ValueError):
        CsvConfig(**{**CONFIG.__dict__, **change})


RAW = {
    "trade": struct.pack(">HcQQQ8scIQB", 47, b"T", 40, 77, 9313, b"QUIX    ", b"S", 9, 31418, 2),
    "add": struct.pack(">HcQQQ8scIQB", 47, b"A", 41, 1650000000000000500, 4207, b"ZORB    ", b"B", 730, 18725, 2),
    "cancel": struct.pack(">HcQQQI", 29, b"C", 42, 1650000000000000501, 4207, 15),
    "execute": struct.pack(">HcQQQI", 29, b"E", 44, 1650000000000009000, 4207, 715),
}


def frames(spark, *raw):
    return spark.createDataFrame([(i, "src", bytearray(b)) for i, b in enumerate(raw, 1)],
                                 "frame_number long, source string, frame binary")


def test_golden_frames(spark):
    good, errors = decode_frames(frames(spark, *RAW.values()))
    rows = good.orderBy("frame_number").collect()
    assert errors.count() == 0
    assert [(r["kind"], r["sequence"], r["event_time"], r["order_id"], r["trade_id"], r["symbol"], r["side"], r["quantity"],
             tuple(r["price"]) if r["price"] else None) for r in rows] == [
        ("TRADE", 40, 77, None, 9313, "QUIX", "SELL", 9, (31418, 2)),
        ("ORDER_ADDED", 41, 1650000000000000500, 4207, None, "ZORB", "BUY", 730, (18725, 2)),
        ("ORDER_CANCELLED", 42, 1650000000000000501, 4207, None, None, None, 15, None),
        ("ORDER_EXECUTED", 44, 1650000000000009000, 4207, None, None, None, 715, None)]


def test_bad_frames(spark):
    add, execute = RAW["add"], RAW["execute"]

    def put(at, data, frame=add):
        return frame[:at] + data + frame[at + len(data):]

    cases = [(b"", "TRUNCATED_FRAME"), (b"\x00", "TRUNCATED_FRAME"), (b"\x00\x00", "INVALID_FRAME_LENGTH"), (add[:-1], "TRUNCATED_FRAME"),
             (add + b"x", "TRAILING_FRAME_BYTES"), (b"\x00\x30" + add[2:] + b"x", "INVALID_FRAME_LENGTH"), (put(3, b"\x80"), "sequence number"),
             (put(3, bytes(8)), "sequence number"), (put(11, b"\xff"), "event timestamp"), (put(19, b"\xff"), "order ID"),
             (put(19, b"\xff", RAW["trade"]), "trade ID"), (put(27, b"A B     "), "symbol"), (put(27, b"        "), "symbol"),
             (put(27, b"\xe9PL     "), "symbol"), (put(35, b"X"), "side"), (put(35, b"b", RAW["trade"]), "aggressor side"),
             (put(36, bytes(4)), "quantity"), (put(27, bytes(4), execute), "executed quantity"), (put(48, b"\x13"), "price")]
    errors = {r["frame_number"]: r for r in decode_frames(frames(spark, *[c for c, _ in cases]))[1].collect()}
    for i, (_, want) in enumerate(cases, 1):
        row = errors[i]
        assert want == row["reason"] or row["detail"].startswith(f"invalid STP {want}: "), (i, want, row)
    unknown = decode_columns(frames(spark, put(2, b"Z"), b"\x00\x01Q")).collect()
    assert [(r["kind"], r["message_type"], r["_issue"]) for r in unknown] == [("UNSUPPORTED", 90, None), ("UNSUPPORTED", 81, None)]


def test_frames_normalize(spark):
    raw = [*RAW.values(), RAW["execute"], b"\x00\x01Q"]
    events, failures = normalize_frames(decode_frames(frames(spark, *raw))[0], "xtst")
    rows = events.orderBy("frame_number").collect()
    assert [(r["instrument"]["symbol"], r["payload"]["type"]) for r in rows] == [
        ("QUIX", "TRADE"), ("ZORB", "ORDER_ADDED"), ("ZORB", "ORDER_CANCELLED"), ("ZORB", "ORDER_EXECUTED")]
    assert rows[0]["metadata"]["venue"] == "XTST" and rows[0]["metadata"]["rawEventReference"] == "stp:src:frame:1"
    assert [(r["frame_number"], r["reason"], r["detail"]) for r in failures.orderBy("frame_number").collect()] == [
        (5, "INSTRUMENT_NOT_RESOLVED", "no instrument is known for STP order 4207"),
        (6, "UNSUPPORTED_MESSAGE_TYPE", "STP message type 81 is not assigned by STP v1")]


def test_capture_framing(spark, tmp_path):
    big = (300).to_bytes(2, "big") + bytes(300)
    write(tmp_path / "a.bin", RAW["add"] + b"\x00\x00" + RAW["execute"] + big + RAW["trade"] + RAW["cancel"][:10])
    write(tmp_path / "b.bin", RAW["trade"] + b"\x00")
    write(tmp_path / "c.bin", b"")
    write(tmp_path / "d.bin", big[:100])
    split = split_capture(spark, str(tmp_path), 128)
    rows = [(r["f"], r["frame_number"], r["reason"] or len(r["frame"])) for r in split.select(
        F.element_at(F.split("file_path", "/"), -1).alias("f"), "frame_number", "reason", "frame").orderBy("f", "frame_number").collect()]
    assert rows == [("a.bin", 1, 49), ("a.bin", 2, "INVALID_FRAME_LENGTH"), ("a.bin", 3, 31), ("a.bin", 4, "FRAME_TOO_LARGE"),
                    ("a.bin", 5, 49), ("a.bin", 6, "TRUNCATED_FRAME"), ("b.bin", 1, 49), ("b.bin", 2, "TRUNCATED_FRAME"),
                    ("d.bin", 1, "FRAME_TOO_LARGE"), ("d.bin", 2, "TRUNCATED_FRAME")]
    good, bad = split_errors(split)
    assert good.count() == 4 and bad.count() == 6
    with pytest.raises(ValueError):
        split_capture(spark, str(tmp_path), 2)
