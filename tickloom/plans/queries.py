"""Registered queries over the given tables, each beside the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.functions.common import keep
from tickloom.functions.fixed import fd_compare, fd_parse, fd_plain, fixed, price_at_scale
from tickloom.functions.ids import DEAD_LETTER_DOMAIN, EVENT_ID_DOMAIN, event_id
from tickloom.functions.jsontext import json_string, json_value
from tickloom.functions.text import binary_payload, pad_symbol, payload_preview, redact_message, redact_payload
from tickloom.functions.times import iso_parse, iso_utc
from tickloom.operators import blueprint as B, conditions as C, transform as X
from tickloom.operators.deadletter import DeadLetterConfig, FAIL_FAST, QUARANTINE, SKIP, dead_letters
from tickloom.operators.document import DOCUMENT
from tickloom.operators.documents import check_document, event_json, find_credential_keys
from tickloom.operators.orders import order_state, resolve_instruments
from tickloom.operators.report import (
    duration_average, event_rate, failure_sample, latest_per_key, recent_dead_letters, run_counters,
    run_outcome, sequence_counters,
)
from tickloom.operators.sequence import sequence_integrity, sequence_strict
from tickloom.operators.validate import normalized, with_validation
from tickloom.plans import views as V
from tickloom.plans.run import Report, process_events, read_jsonl_input, run
from tickloom.schema import MAX_LONG
from tickloom.sinks.files import read_dead_letters, write_csv, write_dead_letters, write_jsonl
from tickloom.sinks.publish import Kind, current_path, publish, renamed, versioned, versions
from tickloom.sources.capture import split_capture, split_errors
from tickloom.sources.csv import CsvConfig, map_trades, read_trades_csv
from tickloom.sources.frames import decode_columns, decode_frames
from tickloom.sources.jsonl import parse_event_lines, read_canonical_jsonl
from tickloom.sources.lines import FILE, read_lines, read_summary, with_ordinal
from tickloom.streaming.pipeline import read_event_stream, start_counter_stream, stream_counters, stream_states
from tickloom.streaming.state import order_state_stream, sequence_integrity_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# -- SQL fragments ----------------------------------------------------------------------------

def s_cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def s_plain(mantissa: str, scale: int) -> str:
    p = 10 ** scale
    return f"(({mantissa}) // {p})::VARCHAR || '.' || lpad((({mantissa}) % {p})::VARCHAR, {scale}, '0')"


def s_event_id(source: str, seq: str) -> str:
    return (f"sha256(encode('{EVENT_ID_DOMAIN}') || unhex('00') || "
            f"unhex(lpad(to_hex(octet_length(encode({source}))), 8, '0')) || encode({source}) || "
            f"unhex(lpad(to_hex(({seq})::BIGINT), 16, '0')))")


S_CSYM = "('C' || to_base(o_custkey, 36))"
S_PSYM = "('P' || to_base(l_partkey, 36))"
S_SIDE = "CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END"
S_NUM = "(l_orderkey * 10 + l_linenumber)"
S_MIXED = f"""m AS (
  SELECT o_orderkey AS k1, 0::BIGINT AS k2, 0::BIGINT AS k3, 0::BIGINT AS k4, 'ORDER_ADDED' AS type,
         {S_CSYM} AS symbol, o_orderkey AS id, {S_SIDE} AS side, NULL::VARCHAR AS aggressor, 80::BIGINT AS qty,
         {s_cents('o_totalprice')} AS cents FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber::BIGINT, l_partkey, l_suppkey, 'TRADE', {S_PSYM}, {S_NUM}, NULL,
         CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' END, CAST(l_quantity AS BIGINT),
         {s_cents('l_extendedprice')} FROM lineitem)"""


def s_payload(price: str | None = s_plain("cents", 2), qty: str | None = "qty::VARCHAR",
              aggressor: str | None = "aggressor", side_key: str | None = "side") -> str:
    """Payload JSON text of table m, members in key order."""
    parts = []
    if aggressor:
        parts.append(("aggressorSide", f"'\"aggressorSide\":\"' || {aggressor} || '\"'"))
    if side_key:
        parts.append((side_key, f"'\"{side_key}\":\"' || side || '\"'"))
    parts.append(("orderId", "CASE WHEN type = 'ORDER_ADDED' THEN '\"orderId\":' || id END"))
    parts.append(("tradeId", "CASE WHEN type = 'TRADE' THEN '\"tradeId\":' || id END"))
    if price:
        parts.append(("price", f"'\"price\":' || {price}"))
    if qty:
        parts.append(("quantity", f"'\"quantity\":' || {qty}"))
    parts.append(("type", "'\"type\":\"' || type || '\"'"))
    inner = ", ".join(sql for _, sql in sorted(parts))
    return f"'{{' || concat_ws(',', {inner}) || '}}'"


def doc_json(df: DataFrame, root: str) -> Column:
    return F.when(F.col(X.STATUS) == X.TRANSFORMED,
                  json_value(F.col(f"{DOCUMENT}.{root}"), df.schema[DOCUMENT].dataType[root].dataType))


def outcome(df: DataFrame, **more: Column) -> DataFrame:
    """Keys, status and failure of a transformed frame, flattened."""
    return df.select("k1", "k2", "k3", "k4", F.col(X.STATUS).alias("status"),
                     F.col(f"{X.FAILURE}.code").alias("code"), F.col(f"{X.FAILURE}.fieldPath").alias("path"),
                     F.col(f"{X.FAILURE}.detail").alias("detail"), *[c.alias(n) for n, c in more.items()])


S_OK = "'TRANSFORMED' AS status, NULL::VARCHAR AS code, NULL::VARCHAR AS path, NULL::VARCHAR AS detail"
ABSENT = "field is absent from this event"


def s_outcome(bad: str, code: str, path: str, detail: str, **more: str) -> str:
    """Outcome columns of table m with one failure condition."""
    cols = "".join(f", CASE WHEN NOT ({bad}) THEN {sql} END AS {n}" for n, sql in more.items())
    return (f"SELECT k1, k2, k3, k4, CASE WHEN {bad} THEN 'FAILED' ELSE 'TRANSFORMED' END AS status, "
            f"CASE WHEN {bad} THEN {code} END AS code, CASE WHEN {bad} THEN '{path}' END AS path, "
            f"CASE WHEN {bad} THEN {detail} END AS detail{cols} FROM m")


# -- whole path -------------------------------------------------------------------------------

RENDER = B.record(
    who=B.reference("instrument.symbol"), side=B.listed(B.reference("payload.side"), B.reference("payload.quantity")),
    made=B.record(at=B.formatted("metadata.exchangeTimestamp", "TIMESTAMP_ISO_UTC"),
                  cost=B.formatted("payload.price", "FIXED_DECIMAL_PLAIN", "transformed"),
                  number=B.reference("metadata.sequenceNumber"), order=B.reference("payload.orderId")))


@query("normalize_filter_render", f"""
WITH a AS (SELECT o_orderkey, {S_CSYM} AS symbol, {S_SIDE} AS side, {s_cents('o_totalprice')} AS cents,
                  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_ns FROM orders)
SELECT o_orderkey, at_ns AS occurred_at, {s_plain('cents * 100', 4)} AS price,
  '{{"made":{{"at":"' || at_ns || '","cost":"' || {s_plain('cents * 100', 4)} || '","number":' || (o_orderkey + 1) ||
  ',"order":' || o_orderkey || '}},"side":["' || side || '",80],"who":"' || symbol || '"}}' AS line
FROM a WHERE cents >= 10000000""")
def normalize_filter_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.apply_transformation(V.adds(spark, sf_dir), [
        {"op": "filter", "condition": C.comparison("payload.price", "GTE", C.decimal(10000000, 2))},
        {"op": "scale_fixed_decimal", "path": "payload.price", "targetScale": 4}], keep_filtered=False)
    out = B.render_blueprint(X.transformed(df), RENDER)
    return out.select("o_orderkey", F.col("output.made.at").alias("occurred_at"),
                      F.col("output.made.cost").alias("price"), F.col(B.OUTPUT_JSON).alias("line"))


@query("event_ids", f"""
SELECT event_id AS n, {s_event_id("('user/' || user_id)", 'event_id + 1')} AS id FROM events
UNION ALL SELECT o_orderkey, {s_event_id("'orders'", 'o_orderkey + 1')} FROM orders""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    users = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("n"), event_id(source, F.col("event_id") + 1).alias("id"))
    return users.unionByName(V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), event_id(F.lit("orders"), F.col("o_orderkey") + 1).alias("id")))


# -- validation and dead letters --------------------------------------------------------------

S_FAULT = f"""f AS (SELECT *, o_orderkey % 25 AS k, {S_CSYM} AS symbol, {s_cents('o_totalprice')} AS cents,
  {s_event_id("'orders'", 'o_orderkey + 1')} AS eid FROM orders),
v AS (SELECT *, CASE
  WHEN k = 4 THEN 'SCHEMA_VERSION' WHEN k = 7 THEN 'INVALID_FIELD' WHEN k = 5 THEN 'INVALID_FIELD'
  WHEN k = 3 THEN 'INVALID_FIELD' WHEN k = 2 THEN 'EVENT_ID_MISMATCH' WHEN k IN (1, 6, 13) THEN 'INVALID_FIELD'
  WHEN k = 8 THEN 'UNSUPPORTED_EVENT_TYPE' WHEN k IN (9, 10, 11) THEN 'INVALID_FIELD'
  WHEN k = 12 THEN 'REQUIRED_FIELD' END AS reason, CASE k
  WHEN 1 THEN 'metadata.venue: venue must use ASCII letters, digits, hyphen, underscore, or period'
  WHEN 2 THEN 'metadata.eventId does not match metadata.source and metadata.sequenceNumber'
  WHEN 3 THEN 'metadata.eventId: event ID must be 64 lowercase hexadecimal characters'
  WHEN 4 THEN 'metadata.schemaVersion must be 1.0'
  WHEN 5 THEN 'metadata.source: source identity must begin with an ASCII letter or digit'
  WHEN 6 THEN 'metadata.rawEventReference: raw event reference must use printable, non-space ASCII characters'
  WHEN 7 THEN 'metadata.exchangeTimestamp is outside its allowed range'
  WHEN 8 THEN 'payload.type is not supported: FOO'
  WHEN 9 THEN 'payload.quantity is outside its allowed range'
  WHEN 10 THEN 'payload.side must be BUY or SELL'
  WHEN 11 THEN 'payload.price.scale is outside its allowed range'
  WHEN 12 THEN 'payload.price is required'
  WHEN 13 THEN 'instrument.symbol: symbol must use printable ASCII with trailing spaces only' END AS detail FROM f)"""


@query("validate_orders", f"""WITH {S_FAULT}
SELECT o_orderkey, eid AS event_id, 'XTPC' AS venue, symbol, {s_plain('cents', 2)} AS price FROM v
WHERE reason IS NULL""")
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = keep(with_validation(V.faulty_adds(spark, sf_dir)), F.col("_issue").isNull())
    return normalized(good).select(
        "o_orderkey", F.col("metadata.eventId").alias("event_id"), F.col("metadata.venue").alias("venue"),
        F.col("instrument.symbol").alias("symbol"), fd_plain(F.col("payload.price")).alias("price"))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(with_validation(V.faulty_adds(spark, sf_dir)), F.col("_issue").isNotNull()).withColumns({
        "reason": F.col("_issue.reason"), "detail": F.col("_issue.detail")})


@query("validate_quarantine", f"WITH {S_FAULT} SELECT o_orderkey, reason, detail FROM v WHERE reason IS NOT NULL")
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(spark, sf_dir).select("o_orderkey", "reason", "detail")


def order_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.concat(F.lit("orders:row "), F.col("o_orderkey").cast("string"))
    message = F.concat(F.col("reason"), F.lit(": "), F.col("detail"))
    return dead_letters(rejected(spark, sf_dir), "PARSE", location, message, "orders-check", "3",
                        at=V.order_time_text(), keep=["o_orderkey", "o_orderpriority"])


S_LETTERS = f"""{S_FAULT}, d AS (SELECT o_orderkey, o_orderpriority, 'orders:row ' || o_orderkey AS location,
  reason || ': ' || detail AS message, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_ns FROM v WHERE reason IS NOT NULL),
l AS (SELECT *, sha256(concat_ws(chr(0), '{DEAD_LETTER_DOMAIN}', 'orders-check', '3', 'PARSE', location, '',
  'MALFORMED_INPUT', message, '1.0', '1.0')) AS failure_id FROM d)"""


@query("dead_letter_rows", f"""WITH {S_LETTERS}
SELECT o_orderkey, 'orders-check' AS pipeline, '3' AS version, 'PARSE' AS stage, location,
  'MALFORMED_INPUT' AS category, message, at_ns, 'NON_RETRYABLE' AS retryability FROM l""")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_letters(spark, sf_dir).select(
        "o_orderkey", F.col("pipelineId").alias("pipeline"), F.col("pipelineVersion").alias("version"), "stage",
        F.col("sourceLocation").alias("location"), "category", F.col("safeMessage").alias("message"),
        F.col("timestamp").alias("at_ns"), "retryability")


@query("failure_ids", f"WITH {S_LETTERS} SELECT o_orderkey, failure_id FROM l")
def failure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_letters(spark, sf_dir).select("o_orderkey", F.col("failureId").alias("failure_id"))


@query("recent_dead_letters", f"""WITH {S_LETTERS}
SELECT o_orderpriority, failure_id, at_ns FROM (SELECT *, row_number() OVER (
  PARTITION BY o_orderpriority ORDER BY at_ns DESC, failure_id) AS rn FROM l) WHERE rn <= 50""")
def recent_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_dead_letters(order_letters(spark, sf_dir), "o_orderpriority").select(
        "o_orderpriority", F.col("failureId").alias("failure_id"), F.col("timestamp").alias("at_ns"))


@query("dead_letter_roundtrip", f"""WITH {S_LETTERS}
SELECT failure_id, location, message FROM l""")
def dead_letter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = V.scratch(spark, "letters")
    write_dead_letters(order_letters(spark, sf_dir), path)
    return read_dead_letters(spark, path).select(
        F.col("failureId").alias("failure_id"), F.col("sourceLocation").alias("location"),
        F.col("safeMessage").alias("message"))


@query("failure_sample", f"""WITH {S_FAULT}
SELECT o_orderkey, detail FROM v WHERE reason IS NOT NULL ORDER BY o_orderkey LIMIT 100""")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_sample(rejected(spark, sf_dir).select("o_orderkey", "detail"), ["o_orderkey"])[0]


@query("failure_suppressed", f"""WITH {S_FAULT}
SELECT greatest(count(*) - 100, 0)::BIGINT AS suppressed FROM v WHERE reason IS NOT NULL""")
def suppressed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_sample(rejected(spark, sf_dir).select("o_orderkey"), ["o_orderkey"])[1]


# -- sources ----------------------------------------------------------------------------------

LINE_CONFIG = CsvConfig(
    source="csv/lineitem", timestamp_column="t", symbol_column="s", venue_column="v", decimal_price_column="p",
    quantity_column="q", side_column="d", side_mapping={"A": "BUY", "R": "SELL"}, price_scale=2,
    timestamp_format="ISO_INSTANT")


@query("csv_style_trades", f"""
WITH c AS (SELECT *, {S_NUM} AS n, {s_cents('l_extendedprice')} AS cents, l_partkey % 17 AS k,
  l_extendedprice FROM lineitem),
r AS (SELECT *, CASE WHEN k = 1 THEN 'INVALID_TIMESTAMP' WHEN k = 2 THEN 'MISSING_COLUMN' WHEN k = 3 THEN 'INVALID_SYMBOL'
  WHEN k = 4 THEN 'INVALID_VENUE' WHEN k IN (5, 6) THEN 'INVALID_DECIMAL' WHEN k IN (7, 8) THEN 'INVALID_QUANTITY'
  WHEN l_returnflag = 'N' THEN 'INVALID_SIDE' END AS reason FROM c)
SELECT n, l_partkey, l_suppkey, reason,
  CASE WHEN reason IS NULL THEN {s_event_id("'csv/lineitem'", 'n')} END AS event_id,
  CASE WHEN reason IS NULL THEN epoch_us(l_shipdate) * 1000 + CASE WHEN k = 9 THEN 123456789 ELSE 0 END END AS at_ns,
  CASE WHEN reason IS NULL THEN {S_PSYM} END AS symbol, CASE WHEN reason IS NULL THEN cents END AS mantissa,
  CASE WHEN reason IS NULL THEN CAST(l_quantity AS BIGINT) END AS quantity,
  CASE WHEN reason IS NULL THEN CASE l_returnflag WHEN 'A' THEN 'BUY' ELSE 'SELL' END END AS side,
  CASE WHEN reason IS NULL THEN 'csv:csv/lineitem:row:' || n END AS reference FROM r""")
def csv_style_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 17
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole = iso_utc(V.nanos("l_shipdate"))
    plain = fd_plain(fixed(V.cents("l_extendedprice"), 2))
    cells = {
        "timestamp": F.when(k == 1, "yesterday").when(k == 9, F.replace(whole, F.lit("Z"), F.lit(".123456789Z")))
        .otherwise(whole),
        "symbol": F.when(k == 3, "TOO LONG SYMBOL").when(k != 2, V.part_symbol()),
        "venue": F.when(k == 4, "x/y").otherwise("xtpc"),
        "decimal price": F.when(k == 5, F.concat(plain, F.lit("1"))).when(k == 6, "n/a")
        .when(k == 10, F.concat(plain, F.lit("000e0"))).when(k == 11, F.concat(V.cents("l_extendedprice").cast("string"), F.lit("E-2")))
        .otherwise(plain),
        "quantity": F.when(k == 7, "0").when(k == 8, " 5").otherwise(F.col("l_quantity").cast("bigint").cast("string")),
        "side": F.col("l_returnflag"),
    }
    staged = V.spread(V.table(spark, sf_dir, "lineitem")).select(
        number.cast("bigint").alias("n"), "l_partkey", "l_suppkey", *[c.alias(f"cell {n}") for n, c in cells.items()])
    out = map_trades(staged, {n: F.col(f"`cell {n}`") for n in cells}, F.col("n"), F.col("n"), LINE_CONFIG)
    ok = F.col("_issue").isNull()
    return out.select(
        "n", "l_partkey", "l_suppkey", F.col("_issue.reason").alias("reason"),
        F.when(ok, F.col("metadata.eventId")).alias("event_id"),
        F.when(ok, F.col("metadata.exchangeTimestamp")).alias("at_ns"),
        F.when(ok, F.col("instrument.symbol")).alias("symbol"),
        F.when(ok, F.col("payload.price.mantissa")).alias("mantissa"),
        F.when(ok, F.col("payload.quantity")).alias("quantity"),
        F.when(ok, F.col("payload.aggressorSide")).alias("side"),
        F.when(ok, F.col("metadata.rawEventReference")).alias("reference"))


@query("sequence_numbers", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'INVALID_FIELD' WHEN 2 THEN 'INVALID_FIELD' WHEN 3 THEN 'REQUIRED_FIELD' END AS reason
  FROM orders""")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey") % 5, F.col("metadata")
    number = F.when(k == 1, F.lit(0)).when(k == 2, F.lit(-5)).when(k == 3, F.lit(None)).otherwise(m["sequenceNumber"]).cast("bigint")
    df = V.adds(spark, sf_dir).withColumn("metadata", m.withField("sequenceNumber", number))
    return with_validation(keep(df, F.col("o_orderkey").isNotNull())).select("o_orderkey", F.col("_issue.reason").alias("reason"))


@query("quotes", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'REQUIRED_FIELD' WHEN 4 THEN 'NORMALIZATION_ERROR' WHEN 5 THEN 'REQUIRED_FIELD' END AS reason,
  CASE event_id % 6 WHEN 0 THEN 'payload.bid or payload.ask is required' WHEN 4 THEN 'quantity must be between 1 and 4294967295'
    WHEN 5 THEN 'payload.ask.price and payload.ask.quantity are required' END AS detail,
  CASE WHEN event_id % 6 IN (1, 3) THEN {s_plain(s_cents('value'), 2)} END AS bid,
  CASE WHEN event_id % 6 IN (2, 3) THEN {s_plain(s_cents('value') + ' + 1', 2)} END AS ask FROM events""")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_event_lines(V.quote_lines(spark, sf_dir), "value")
    good = F.col("_issue").isNull()
    return parsed.select("event_id", F.col("_issue.reason").alias("reason"), F.col("_issue.detail").alias("detail"),
                         F.when(good, fd_plain(F.col("payload.bid.price"))).alias("bid"),
                         F.when(good, fd_plain(F.col("payload.ask.price"))).alias("ask"))


def event_files(spark: SparkSession, sf_dir: str, files: int = 5) -> str:
    """Folder with the JSON lines of events, one subfolder for each remainder of the id; the lines of one are in the order of ids."""
    path = V.scratch(spark, "event-lines")
    V.json_lines(spark, sf_dir).select((F.col("event_id") % files).alias("file"), "event_id", "value") \
        .repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    return path


def file_number() -> Column:
    return F.regexp_extract(FILE, "/file=([0-9]+)/", 1).cast("bigint")


@query("line_numbers", """SELECT file, event_id, line FROM (SELECT event_id % 5 AS file, event_id,
  row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS line FROM events) WHERE event_id % 23 NOT IN (21, 22)""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = with_ordinal(read_lines(spark, f"{event_files(spark, sf_dir)}/file=*"))
    return lines.select(file_number().alias("file"), F.regexp_extract("value", '"events:([0-9]+)"', 1).alias("id"),
                        F.col("line_number").alias("line")).filter("id <> ''").select("file", F.col("id").cast("bigint").alias("event_id"), "line")


@query("read_summary", """SELECT event_id % 5 AS file, count(*) AS rows_read,
  count(*) FILTER (WHERE event_id % 23 IN (0, 11)) AS events_produced, count(*) FILTER (WHERE event_id % 23 NOT IN (0, 11)) AS errors_reported
FROM events GROUP BY ALL""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, errors = read_canonical_jsonl(spark, f"{event_files(spark, sf_dir)}/file=*")
    return read_summary(events, errors).select(file_number().alias("file"), "rows_read", "events_produced", "errors_reported")


S_FEED = """s AS (SELECT event_id, CASE WHEN event_id % 23 NOT IN (0, 11) THEN 'PARSE_FAILED' WHEN event_id % 97 + 1 > 40 THEN 'EMITTED' ELSE 'FILTERED' END AS state FROM events)"""
FEED_RULES = [{"op": "filter", "condition": C.comparison("payload.quantity", "GT", C.int64(40))}]


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, one file in a micro-batch, with the state of each row."""
    return stream_states(read_event_stream(spark, f"{event_files(spark, sf_dir)}/file=*", maxFilesPerTrigger="1"), FEED_RULES)


@query("stream_states", f"WITH {S_FEED} SELECT event_id, state, state = 'EMITTED' AS good FROM s WHERE state <> 'PARSE_FAILED'")
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark = V.scratch(spark, "feed-out"), V.scratch(spark, "feed-state")
    keep(event_feed(spark, sf_dir), F.col("state") != "PARSE_FAILED").select(
        (F.col("metadata.sequenceNumber") - 1).alias("event_id"), "state", (F.col("state") == "EMITTED").alias("good")) \
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", mark) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, state string, good boolean").parquet(out)


@query("stream_counters", f"""WITH {S_FEED} SELECT count(*) AS received, count(*) FILTER (WHERE state <> 'PARSE_FAILED') AS parsed,
  count(*) FILTER (WHERE state <> 'PARSE_FAILED') AS normalized, count(*) FILTER (WHERE state = 'FILTERED') AS filtered,
  count(*) FILTER (WHERE state = 'EMITTED') AS emitted, count(*) FILTER (WHERE state = 'PARSE_FAILED') AS failed FROM s""")
def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark = V.scratch(spark, "feed-counts"), V.scratch(spark, "feed-state")
    start_counter_stream(event_feed(spark, sf_dir), out, mark).awaitTermination()
    return stream_counters(spark, out)


S_LINE_REASON = """CASE k WHEN 1 THEN 'MALFORMED_JSON' WHEN 2 THEN 'EVENT_ID_MISMATCH' WHEN 3 THEN 'SCHEMA_VERSION'
  WHEN 4 THEN 'INVALID_FIELD' WHEN 5 THEN 'REQUIRED_FIELD' WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'MALFORMED_JSON'
  WHEN 8 THEN 'INVALID_FIELD' WHEN 9 THEN 'UNSUPPORTED_EVENT_TYPE' WHEN 10 THEN 'INVALID_FIELD'
  WHEN 12 THEN 'REQUIRED_FIELD' WHEN 13 THEN 'INVALID_FIELD' WHEN 14 THEN 'INVALID_FIELD' WHEN 15 THEN 'INVALID_FIELD'
  WHEN 16 THEN 'INVALID_FIELD' WHEN 17 THEN 'INVALID_FIELD' WHEN 18 THEN 'INVALID_FIELD' WHEN 19 THEN 'MALFORMED_JSON'
  WHEN 20 THEN 'MALFORMED_JSON' WHEN 21 THEN 'EMPTY_LINE' WHEN 22 THEN 'MALFORMED_JSON' END"""


@query("jsonl_errors", f"""
WITH e AS (SELECT *, event_id % 23 AS k, {s_cents('value')} AS cents FROM events),
r AS (SELECT *, {S_LINE_REASON} AS reason FROM e)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN event_id + 1 END AS sequence,
  CASE WHEN reason IS NULL THEN epoch_us(ts) * 1000 END AS at_ns,
  CASE WHEN reason IS NULL THEN 'XTPC' END AS venue,
  CASE WHEN reason IS NULL THEN upper(event_type) END AS symbol,
  CASE WHEN reason IS NULL THEN event_id % 97 + 1 END AS quantity,
  CASE WHEN reason IS NULL THEN cents END AS mantissa,
  CASE WHEN reason IS NULL AND k <> 11 THEN 'BUY' END AS side FROM r""")
def jsonl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = parse_event_lines(V.json_lines(spark, sf_dir))
    ok = F.col("_issue").isNull()
    return parsed.select(
        "event_id", F.col("_issue.reason").alias("reason"),
        F.when(ok, F.col("metadata.sequenceNumber")).alias("sequence"),
        F.when(ok, F.col("metadata.exchangeTimestamp")).alias("at_ns"),
        F.when(ok, F.upper("metadata.venue")).alias("venue"), F.when(ok, F.col("instrument.symbol")).alias("symbol"),
        F.when(ok, F.col("payload.quantity")).alias("quantity"),
        F.when(ok, F.col("payload.price.mantissa")).alias("mantissa"),
        F.when(ok, F.col("payload.aggressorSide")).alias("side"))


@query("decode_frames", f"""
WITH a AS (SELECT o_orderkey AS k1, 0::BIGINT AS k2, o_orderkey % 20 AS k, epoch_us(o_orderdate) * 1000 AS at_ns,
  o_orderkey % 2 AS odd, {S_CSYM} AS symbol, {s_cents('o_totalprice')} AS cents FROM orders),
r AS (SELECT *, CASE k WHEN 2 THEN 'INVALID_FIELD_ENCODING' WHEN 3 THEN 'INVALID_FIELD_ENCODING'
  WHEN 4 THEN 'INVALID_FIELD_ENCODING' WHEN 5 THEN 'INVALID_FIELD_ENCODING' WHEN 6 THEN 'INVALID_FIELD_ENCODING'
  WHEN 7 THEN 'TRUNCATED_FRAME' WHEN 8 THEN 'TRAILING_FRAME_BYTES' WHEN 9 THEN 'INVALID_FRAME_LENGTH'
  WHEN 10 THEN 'TRUNCATED_FRAME' WHEN 11 THEN 'INVALID_FRAME_LENGTH' END AS reason, CASE k
  WHEN 2 THEN 'invalid STP sequence number: sequence number must be positive'
  WHEN 3 THEN 'invalid STP symbol: symbol must use printable ASCII with trailing spaces only'
  WHEN 4 THEN 'invalid STP side: side must be B or S'
  WHEN 5 THEN 'invalid STP quantity: quantity must be between 1 and 4294967295'
  WHEN 6 THEN 'invalid STP price: scale must be between 0 and 18'
  WHEN 7 THEN 'STP frame requires 49 bytes but only 48 are available'
  WHEN 8 THEN 'STP frame declares 49 bytes but input contains 50'
  WHEN 9 THEN 'encoded length must be between 1 and 65535: 0'
  WHEN 10 THEN 'STP frame requires 2 bytes but only 1 are available'
  WHEN 11 THEN 'encoded length for ADD_ORDER must be 47: 48' END AS detail FROM a)
SELECT k1, k2, reason, detail,
  CASE WHEN reason IS NULL THEN CASE WHEN k = 1 THEN 'UNSUPPORTED' ELSE 'ORDER_ADDED' END END AS kind,
  CASE WHEN reason IS NULL AND k <> 1 THEN k1 + 1 END AS sequence, CASE WHEN reason IS NULL AND k <> 1 THEN at_ns END AS at_ns,
  CASE WHEN reason IS NULL AND k <> 1 THEN k1 END AS order_id,
  CASE WHEN reason IS NULL AND k <> 1 THEN symbol END AS symbol,
  CASE WHEN reason IS NULL AND k <> 1 THEN CASE WHEN odd = 0 THEN 'BUY' ELSE 'SELL' END END AS side,
  CASE WHEN reason IS NULL AND k <> 1 THEN 80::BIGINT END AS quantity,
  CASE WHEN reason IS NULL AND k <> 1 THEN {s_plain('cents', 2)} END AS price FROM r
UNION ALL
SELECT l_orderkey, {S_NUM}, CASE WHEN {S_NUM} < 1 THEN 'INVALID_FIELD_ENCODING' END, CASE WHEN {S_NUM} < 1 THEN
    'invalid STP sequence number: sequence number must be positive' END,
  CASE WHEN l_returnflag = 'R' THEN 'ORDER_CANCELLED' ELSE 'ORDER_EXECUTED' END, {S_NUM}, epoch_us(l_shipdate) * 1000,
  l_orderkey, NULL, NULL, CAST(l_quantity AS BIGINT), NULL FROM lineitem""")
def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_columns(V.frame_rows(spark, sf_dir))
    ok = F.col("_issue").isNull()
    return d.select(
        "k1", "k2", F.col("_issue.reason").alias("reason"), F.col("_issue.detail").alias("detail"),
        *[F.when(ok, F.col(c)).alias(n) for c, n in (
            ("kind", "kind"), ("sequence", "sequence"), ("event_time", "at_ns"), ("order_id", "order_id"),
            ("symbol", "symbol"), ("side", "side"), ("quantity", "quantity"))],
        F.when(ok, fd_plain(F.col("price"))).alias("price"))


@query("capture_split", f"""
SELECT 'ORDER_ADDED' AS kind, o_orderkey + 1 AS sequence, o_orderkey AS order_id, 80::BIGINT AS quantity,
  {s_plain(s_cents('o_totalprice'), 10)} AS price FROM orders
UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'ORDER_CANCELLED' ELSE 'ORDER_EXECUTED' END, {S_NUM} + 1, l_orderkey,
  CAST(l_quantity AS BIGINT) * 256 + 10, NULL FROM lineitem""")
def capture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files written from the tables, then split and decoded.

    Every frame ends in byte 0A (scale 10, or a quantity with that low byte), so the text writer's
    line feed is the frame's own last byte and Spark writes the binary files in parallel.
    """
    key, number = F.col("o_orderkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    h = V.hex_long
    add = V.spread(V.table(spark, sf_dir, "orders")).select(F.unhex(F.concat(
        F.lit("002F41"), h(key + 1, 8), h(V.nanos("o_orderdate"), 8), h(key, 8),
        F.hex(F.encode(F.rpad(V.customer_symbol(), 8, " "), "US-ASCII")), F.lit("42"), h(F.lit(80), 4),
        h(V.cents("o_totalprice"), 8))).cast("string").alias("value"))
    less = V.spread(V.table(spark, sf_dir, "lineitem")).select(F.unhex(F.concat(
        F.lit("001D"), F.when(F.col("l_returnflag") == "R", "43").otherwise("45"), h(number + 1, 8),
        h(V.nanos("l_shipdate"), 8), h(F.col("l_orderkey"), 8),
        F.substring(h(F.col("l_quantity"), 4), 3, 6))).cast("string").alias("value"))
    path = V.scratch(spark, "capture")
    add.unionByName(less).write.text(path)
    frames, _ = split_errors(split_capture(spark, path))
    d, _ = decode_frames(frames)
    return d.select("kind", "sequence", "order_id", "quantity", fd_plain(F.col("price")).alias("price"))


# -- transformation ---------------------------------------------------------------------------

@query("select_fields", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, {S_OK}, '{{"symbol":"' || symbol || '"}}' AS instrument,
  '{{"price":' || {s_plain('cents', 2)} || ',"type":"' || type || '"}}' AS payload FROM m""")
def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.select_fields(V.mixed(spark, sf_dir), ["instrument.symbol", "payload.price"])
    return outcome(out, instrument=doc_json(out, "instrument"), payload=doc_json(out, "payload"))


@query("rename_field", f"WITH {S_MIXED} " + s_outcome(
    "side IS NULL", "'MISSING_FIELD'", "payload.side", f"'{ABSENT}'", payload=s_payload(side_key="direction")))
def rename_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.rename_field(V.mixed(spark, sf_dir), "payload.side", "payload.direction")
    return outcome(out, payload=doc_json(out, "payload"))


@query("remove_field", f"WITH {S_MIXED} " + s_outcome(
    "aggressor IS NULL", "'MISSING_FIELD'", "payload.aggressorSide", f"'{ABSENT}'", payload=s_payload(aggressor=None)))
def remove_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.remove_field(V.mixed(spark, sf_dir), "payload.aggressorSide")
    return outcome(out, payload=doc_json(out, "payload"))


@query("add_constant", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, {S_OK},
  '{{"currency":"USD","symbol":"' || symbol || '"}}' AS instrument FROM m""")
def add_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.add_constant(V.mixed(spark, sf_dir), "instrument.currency", C.text("USD"))
    return outcome(out, instrument=doc_json(out, "instrument"))


@query("create_object", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, {S_OK}, '{{}}' AS extra FROM m""")
def create_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.create_object(V.mixed(spark, sf_dir), "extra")
    return outcome(out, extra=doc_json(out, "extra"))


@query("conditional_field", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, {S_OK},
  '{{"large":' || CASE WHEN qty > 25 THEN 'true' ELSE 'false' END || ',"symbol":"' || symbol || '"}}' AS instrument FROM m""")
def conditional_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.conditional_field(V.mixed(spark, sf_dir), "instrument.large",
                              C.comparison("payload.quantity", "GT", C.int64(25)), C.flag(True), C.flag(False))
    return outcome(out, instrument=doc_json(out, "instrument"))


@query("filter_not_equal", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, CASE WHEN type = 'TRADE' AND aggressor IS NULL THEN 'FAILED'
  WHEN type = 'ORDER_ADDED' THEN 'FAILED' WHEN aggressor <> 'BUY' AND qty <> 25 AND cents <> 100000 THEN 'TRANSFORMED' ELSE 'FILTERED' END AS status FROM m""")
def filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.apply_transformation(V.mixed(spark, sf_dir), [{"op": "filter", "condition": C.all_of(
        C.comparison("payload.aggressorSide", "NE", C.enum("BUY")), C.comparison("payload.quantity", "NE", C.int64(25)),
        C.comparison("payload.price", "NE", C.decimal(1000, 0)))}])
    return outcome(out).select("k1", "k2", "k3", "k4", "status")


@query("cast_to_own_type", f"WITH {S_MIXED} " + s_outcome(
    "aggressor IS NULL", "'MISSING_FIELD'", "payload.aggressorSide", f"'{ABSENT}'", payload=s_payload()))
def cast_to_own_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.apply_transformation(V.mixed(spark, sf_dir), [
        {"op": "cast", "path": "payload.quantity", "toType": "INT64"},
        {"op": "cast", "path": "payload.aggressorSide", "toType": "STRING"}])
    return outcome(out, payload=doc_json(out, "payload"))


@query("field_limit", f"""WITH {S_MIXED}, c AS (SELECT *, 10 + 2 + 6 + CASE WHEN type = 'ORDER_ADDED' OR aggressor IS NOT NULL THEN 1 ELSE 0 END AS n FROM m)
SELECT k1, k2, k3, k4, CASE WHEN n > 18 THEN 'FAILED' ELSE 'TRANSFORMED' END AS status, CASE WHEN n > 18 THEN 'OUTPUT_FIELD_LIMIT_EXCEEDED' END AS code FROM c""")
def field_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.apply_transformation(V.mixed(spark, sf_dir), [
        {"op": "add_constant", "path": "payload.note", "value": C.text("x")}], limits=X.Limits(max_fields=18))
    return outcome(out).select("k1", "k2", "k3", "k4", "status", "code")


@query("map_enum", f"WITH {S_MIXED} " + s_outcome(
    "aggressor IS NULL OR aggressor = 'SELL'", "CASE WHEN aggressor IS NULL THEN 'MISSING_FIELD' ELSE 'UNMAPPED_ENUM_VALUE' END",
    "payload.aggressorSide", f"CASE WHEN aggressor IS NULL THEN '{ABSENT}' ELSE 'enum mapping has no entry for value: SELL' END",
    payload=s_payload(aggressor="'B'")))
def map_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.map_enum(V.mixed(spark, sf_dir), "payload.aggressorSide", {"BUY": "B"})
    return outcome(out, payload=doc_json(out, "payload"))


@query("scale_decimal", f"WITH {S_MIXED} " + s_outcome(
    "cents % 10 <> 0", "'PRECISION_LOSS'", "payload.price",
    "'scale change would lose precision or overflow: scale reduction would discard nonzero fractional digits'",
    payload=s_payload(price=s_plain("cents // 10", 1))))
def scale_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.scale_decimal(V.mixed(spark, sf_dir), "payload.price", 1)
    return outcome(out, payload=doc_json(out, "payload"))


@query("cast_field", f"""WITH {S_MIXED} SELECT k1, k2, k3, k4, {S_OK}, {s_payload(price="'\"' || " + s_plain('cents', 2) + " || '\"'",
  qty="qty::VARCHAR")} AS payload FROM m""")
def cast_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.apply_transformation(V.mixed(spark, sf_dir), [
        {"op": "cast", "path": "payload.price", "toType": "STRING"},
        {"op": "cast", "path": "payload.quantity", "toType": "FIXED_DECIMAL"}])
    return outcome(out, payload=doc_json(out, "payload"))


@query("cast_matrix", f"""
WITH c AS (SELECT *, {s_cents('l_extendedprice')} AS cents, l_partkey % 8 AS k,
  l_quantity::BIGINT AS q, epoch_us(l_shipdate) * 1000 AS at_ns FROM lineitem),
t AS (SELECT *, CASE k WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'True' WHEN 3 THEN q::VARCHAR
  WHEN 4 THEN '-' || q WHEN 5 THEN {s_plain('cents', 2)} WHEN 6 THEN ' ' || q ELSE '' END AS x FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x,
  CASE x WHEN 'true' THEN true WHEN 'false' THEN false END AS to_boolean,
  CASE WHEN k IN (3, 4) THEN CAST(x AS BIGINT) END AS to_long,
  CASE WHEN k IN (3, 4, 5) THEN x END AS to_decimal,
  CASE WHEN k <> 7 THEN x END AS to_enum,
  CASE WHEN k = 3 THEN q END AS to_nanos,
  CASE WHEN q > 25 THEN 'true' ELSE 'false' END AS boolean_text, q::VARCHAR AS long_text, q::VARCHAR AS long_decimal,
  {s_plain('cents', 2)} AS decimal_text, at_ns::VARCHAR AS nanos_text, at_ns AS nanos_long FROM t""")
def cast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 8
    base = V.spread(V.table(spark, sf_dir, "lineitem")).select(
        *V.LINE_KEY, k.alias("k"), F.col("l_quantity").cast("bigint").alias("q"), V.nanos("l_shipdate").alias("at_ns"),
        fixed(V.cents("l_extendedprice"), 2).alias("price"))
    q = F.col("q").cast("string")
    base = base.withColumn("x", F.when(k == 0, "true").when(k == 1, "false").when(k == 2, "True").when(k == 3, q)
                           .when(k == 4, F.concat(F.lit("-"), q)).when(k == 5, fd_plain(F.col("price")))
                           .when(k == 6, F.concat(F.lit(" "), q)).otherwise(""))

    def cast(column: Column, source: str, target: str) -> Column:
        return X.cast_value(column, source, target)[0]

    x = F.col("x")
    return base.select(
        *V.LINE_KEY, "x", cast(x, "STRING", "BOOLEAN").alias("to_boolean"), cast(x, "STRING", "INT64").alias("to_long"),
        fd_plain(cast(x, "STRING", "FIXED_DECIMAL")).alias("to_decimal"), cast(x, "STRING", "ENUM").alias("to_enum"),
        cast(x, "STRING", "TIMESTAMP_NANOS").alias("to_nanos"), cast(F.col("q") > 25, "BOOLEAN", "STRING").alias("boolean_text"),
        cast(F.col("q"), "INT64", "STRING").alias("long_text"),
        fd_plain(cast(F.col("q"), "INT64", "FIXED_DECIMAL")).alias("long_decimal"),
        cast(F.col("price"), "FIXED_DECIMAL", "STRING").alias("decimal_text"),
        cast(F.col("at_ns"), "TIMESTAMP_NANOS", "STRING").alias("nanos_text"),
        cast(F.col("at_ns"), "TIMESTAMP_NANOS", "INT64").alias("nanos_long"))


CHOICE = C.all_of(
    C.any_of(C.comparison("payload.price", "LT", C.decimal(500000, 1)),
             C.comparison("payload.aggressorSide", "EQ", C.enum("BUY"))),
    C.negate(C.comparison("payload.quantity", "LTE", C.int64(4))))


@query("filter_all_any_not", f"""WITH {S_MIXED}, r AS (SELECT *, CASE
  WHEN cents >= 5000000 AND aggressor IS NULL THEN 'FAILED'
  WHEN NOT (cents < 5000000 OR aggressor = 'BUY') OR qty <= 4 THEN 'FILTERED' ELSE 'TRANSFORMED' END AS status FROM m)
SELECT k1, k2, k3, k4, status, CASE WHEN status = 'FAILED' THEN 'MISSING_FIELD' END AS code,
  CASE WHEN status = 'FAILED' THEN 'payload.aggressorSide' END AS path,
  CASE WHEN status = 'FAILED' THEN '{ABSENT}' END AS detail FROM r""")
def filter_all_any_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(X.filter_events(V.mixed(spark, sf_dir), CHOICE))


RULES = [
    {"op": "enum_map", "path": "payload.aggressorSide", "mapping": {"SELL": "-", "BUY": "+"}},
    {"op": "rename", "from": "payload.quantity", "to": "payload.lots"},
    {"op": "filter", "condition": C.comparison("payload.lots", "LTE", C.int64(40))},
    {"op": "scale_fixed_decimal", "path": "payload.price", "targetScale": 1},
    {"op": "create_object", "path": "desk"},
    {"op": "conditional_field", "path": "desk.size", "condition": C.comparison("payload.price", "LT", C.decimal(3000, 0)),
     "whenTrue": C.text("small"), "whenFalse": C.text("big")},
    {"op": "cast", "path": "payload.lots", "toType": "STRING"},
    {"op": "add_constant", "path": "desk.rank", "value": C.int64(3)},
    {"op": "remove", "path": "payload.aggressorSide"},
    {"op": "select", "fields": ["desk", "payload.lots", "payload.price"]},
]


@query("transform_outcomes", f"""WITH {S_MIXED}, r AS (SELECT CASE WHEN aggressor IS NULL THEN 'FAILED' WHEN qty > 40 THEN 'FILTERED'
  WHEN cents % 10 <> 0 THEN 'FAILED' ELSE 'TRANSFORMED' END AS status,
  CASE WHEN aggressor IS NULL THEN 'MISSING_FIELD' WHEN qty > 40 THEN NULL WHEN cents % 10 <> 0 THEN 'PRECISION_LOSS' END AS code,
  CASE WHEN aggressor IS NULL THEN 0 WHEN qty > 40 THEN NULL WHEN cents % 10 <> 0 THEN 3 END AS op_index,
  CASE WHEN aggressor IS NULL THEN 'enum_map' WHEN qty > 40 THEN NULL WHEN cents % 10 <> 0 THEN 'scale_fixed_decimal' END AS op,
  CASE WHEN aggressor IS NULL THEN 'payload.aggressorSide' WHEN qty > 40 THEN NULL WHEN cents % 10 <> 0 THEN 'payload.price' END AS path
  FROM m) SELECT status, code, op_index, op, path, count(*) AS n FROM r GROUP BY ALL""")
def transform_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col(X.FAILURE)
    return X.apply_transformation(V.mixed(spark, sf_dir), RULES).groupBy(
        F.col(X.STATUS).alias("status"), f["code"].alias("code"), f["operationIndex"].alias("op_index"),
        f["operationName"].alias("op"), f["fieldPath"].alias("path")).agg(F.count("*").alias("n"))


@query("transform_documents", f"""WITH {S_MIXED}
SELECT k1, k2, k3, k4, '{{"desk":{{"rank":3,"size":"' || CASE WHEN cents < 300000 THEN 'small' ELSE 'big' END ||
  '"}},"payload":{{"lots":"' || qty || '","price":' || {s_plain('cents // 10', 1)} || ',"type":"TRADE"}}}}' AS doc FROM m
WHERE aggressor IS NOT NULL AND qty <= 40 AND cents % 10 = 0""")
def transform_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.apply_transformation(V.mixed(spark, sf_dir), RULES, keep_filtered=False)
    doc = X.transformed(out)
    body = {f.name: f.dataType for f in doc.schema[DOCUMENT].dataType.fields if f.name != "metadata"}
    small = F.struct(*[F.col(f"{DOCUMENT}.{n}").alias(n) for n in body])
    dtype = T.StructType([doc.schema[DOCUMENT].dataType[n] for n in body])
    return doc.select("k1", "k2", "k3", "k4", json_value(small, dtype).alias("doc"))


@query("fixed_decimal_compare", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s_cents('l_extendedprice')} AS a, l_partkey % 19 AS s,
  {s_cents('l_extendedprice')} * 10 + (l_suppkey % 3) - 1 AS b FROM lineitem),
p AS (SELECT *, [1::HUGEINT,10,100,1000,10000,100000,1000000,10000000,100000000,1000000000,10000000000,100000000000,1000000000000,
  10000000000000,100000000000000,1000000000000000,10000000000000000,100000000000000000,1000000000000000000] AS pow FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN a::HUGEINT * pow[17] < b::HUGEINT * pow[19 - s] THEN -1 WHEN a::HUGEINT * pow[17] > b::HUGEINT * pow[19 - s] THEN 1 ELSE 0 END AS by_scale,
  CASE WHEN a::HUGEINT * 10 < b THEN -1 WHEN a::HUGEINT * 10 > b THEN 1 ELSE 0 END AS near FROM p""")
def fixed_decimal_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.cents("l_extendedprice")
    b = a * 10 + F.col("l_suppkey") % 3 - 1
    base = V.spread(V.table(spark, sf_dir, "lineitem")).select(
        *V.LINE_KEY, fixed(a, 2).alias("a"), fixed(b, F.col("l_partkey") % 19).alias("b"), fixed(b, 3).alias("c"))
    return base.select(*V.LINE_KEY, fd_compare(F.col("a"), F.col("b")).alias("by_scale"),
                       fd_compare(F.col("a"), F.col("c")).alias("near"))


MIXED_BLUEPRINT = B.record(
    symbol=B.reference("instrument.symbol"),
    flags=B.listed(B.constant("market-data"), B.when(B.test("payload.quantity", "GT", C.int64(25)), B.constant(True)),
                   B.constant(7), B.constant(B.Decimal("1.50"))),
    side=B.when(B.test("payload.type", "EQ", C.enum("ORDER_ADDED")), B.reference("payload.side")),
    aggressor=B.when(B.test("payload.type", "EQ", C.enum("TRADE")), B.reference("payload.aggressorSide")),
    price=B.reference("payload.price"))


@query("blueprint_conditional", f"""WITH {S_MIXED}
SELECT k1, k2, k3, k4, CASE WHEN type = 'TRADE' AND aggressor IS NULL THEN '$.aggressor.value' END AS location,
  CASE WHEN type = 'TRADE' AND aggressor IS NULL THEN 'referenced canonical field is absent: payload.aggressorSide' END AS detail,
  CASE WHEN NOT (type = 'TRADE' AND aggressor IS NULL) THEN '{{' || CASE WHEN type = 'TRADE' THEN '"aggressor":"' || aggressor || '",' ELSE '' END ||
  '"flags":["market-data",' || CASE WHEN qty > 25 THEN 'true,' ELSE '' END || '7,1.50],"price":' || {s_plain('cents', 2)} ||
  CASE WHEN type = 'TRADE' THEN '' ELSE ',"side":"' || side || '"' END || ',"symbol":"' || symbol || '"}}' END AS line FROM m""")
def blueprint_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.render_blueprint(V.mixed(spark, sf_dir), MIXED_BLUEPRINT)
    return out.select("k1", "k2", "k3", "k4", F.col(f"{B.BLUEPRINT_FAILURE}.path").alias("location"),
                      F.col(f"{B.BLUEPRINT_FAILURE}.detail").alias("detail"), F.col(B.OUTPUT_JSON).alias("line"))


@query("event_documents", f"""
SELECT o_orderkey, '{{"instrument":{{"symbol":"' || {S_CSYM} || '"}},"metadata":{{"eventId":"' || {s_event_id("'orders'", 'o_orderkey + 1')} ||
  '","exchangeTimestamp":' || (epoch_us(o_orderdate) * 1000) || ',"rawEventReference":"orders:' || o_orderkey ||
  '","schemaVersion":{{"major":1,"minor":0}},"sequenceNumber":' || (o_orderkey + 1) || ',"source":"orders","venue":"XTPC"}},' ||
  '"payload":{{"orderId":' || o_orderkey || ',"price":' || {s_plain(s_cents('o_totalprice'), 2)} || ',"quantity":80,"side":"' || {S_SIDE} ||
  '","type":"ORDER_ADDED"}}}}' AS doc FROM orders""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.adds(spark, sf_dir)
    return df.select("o_orderkey", event_json(df).alias("doc"))


# -- scalar functions -------------------------------------------------------------------------

@query("iso_instants", """
WITH t AS (SELECT event_id, event_id % 4 AS k, ts, epoch_us(ts) AS us FROM events),
n AS (SELECT *, CASE k WHEN 0 THEN us // 1000000 * 1000000000 WHEN 1 THEN us // 1000 * 1000000 WHEN 2 THEN us * 1000
  ELSE us * 1000 + event_id % 1000 END AS ns FROM t),
f AS (SELECT *, ns % 1000000000 AS fr FROM n)
SELECT event_id, ns, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN fr = 0 THEN '' WHEN fr % 1000000 = 0 THEN '.' || lpad((fr // 1000000)::VARCHAR, 3, '0')
  WHEN fr % 1000 = 0 THEN '.' || lpad((fr // 1000)::VARCHAR, 6, '0') ELSE '.' || lpad(fr::VARCHAR, 9, '0') END || 'Z' AS iso, ns AS parsed FROM f""")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, us = F.col("event_id") % 4, F.unix_micros(F.col("ts").cast("timestamp"))

    def div(x: Column, by: int) -> Column:
        return F.call_function("div", x, F.lit(by).cast("bigint"))

    ns = (F.when(k == 0, div(us, 1_000_000) * 1_000_000_000).when(k == 1, div(us, 1000) * 1_000_000)
          .when(k == 2, us * 1000).otherwise(us * 1000 + F.col("event_id") % 1000))
    base = V.table(spark, sf_dir, "events").select("event_id", ns.alias("ns"))
    base = base.withColumn("iso", iso_utc(F.col("ns")))
    return base.withColumn("parsed", iso_parse(F.col("iso")))


@query("decimal_texts", f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s_cents('l_extendedprice')} AS cents, l_partkey % 19 AS s FROM lineitem),
w AS (SELECT *, lpad(cents::VARCHAR, greatest(length(cents::VARCHAR), s + 1)::INTEGER, '0') AS d FROM c),
t AS (SELECT *, '-' || CASE WHEN s = 0 THEN d ELSE substr(d, 1, (length(d) - s)::INTEGER) || '.' || substr(d, (length(d) - s + 1)::INTEGER) END AS x FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x AS plain, -cents AS mantissa, s AS scale,
  CASE WHEN s <= 2 THEN -cents * CASE s WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 1 END
       WHEN s = 3 AND cents % 10 = 0 THEN -cents // 10 WHEN s = 4 AND cents % 100 = 0 THEN -cents // 100
       WHEN s = 5 AND cents % 1000 = 0 THEN -cents // 1000 WHEN s = 6 AND cents % 10000 = 0 THEN -cents // 10000
       WHEN s = 7 AND cents % 100000 = 0 THEN -cents // 100000 WHEN s = 8 AND cents % 1000000 = 0 THEN -cents // 1000000
       WHEN s = 9 AND cents % 10000000 = 0 THEN -cents // 10000000 END AS price FROM t""")
def decimal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.spread(V.table(spark, sf_dir, "lineitem")).select(
        *V.LINE_KEY, fixed(-V.cents("l_extendedprice"), F.col("l_partkey") % 19).alias("fd"))
    base = base.withColumn("plain", fd_plain(F.col("fd")))
    parsed = base.withColumn("back", fd_parse(F.col("plain")))
    return parsed.select(*V.LINE_KEY, "plain", F.col("back.mantissa").alias("mantissa"),
                         F.col("back.scale").cast("bigint").alias("scale"),
                         price_at_scale(F.col("plain"), 2).alias("price"))


@query("symbol_padding", f"SELECT o_orderkey, rpad({S_CSYM}, 8, ' ') AS padded, {S_CSYM} AS symbol FROM orders")
def symbol_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.table(spark, sf_dir, "orders").select("o_orderkey", pad_symbol(V.customer_symbol()).alias("padded"))
    return base.withColumn("symbol", F.rtrim("padded"))


S_TEXTS = """x AS (SELECT 'documents' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)"""


@query("redact_messages", f"""WITH {S_TEXTS}, y AS (SELECT *, regexp_replace(CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 'unspecified failure'
  ELSE regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g') END, '(?i)(password|token|secret|api[_-]?key)\\s*[:=]\\s*[^,\\s]+', '\\1=[REDACTED]', 'g') AS s FROM x)
SELECT kind, id, turn, CASE WHEN length(s) <= 512 THEN s ELSE substr(s, 1, 512) || '...' END AS message FROM y""")
def redact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.texts(spark, sf_dir).select("kind", "id", "turn", redact_message(F.col("text")).alias("message"))


def s_cut(name: str, limit: str) -> str:
    """Text of the longest whole-character prefix of hex text h within ``limit`` bytes."""
    return (f"CASE WHEN length(h) <= 2 * ({limit}) THEN s ELSE decode(unhex(substr(h, 1, 2 * (({limit}) - CASE "
            + " ".join(f"WHEN substr(h, 2 * (({limit}) - {b}) + 1, 1) NOT IN ('8','9','A','B') THEN {b}" for b in range(3))
            + f" ELSE 3 END)))) END AS {name}")


S_PAYLOAD_PATTERN = ("(?i)(password|token|secret|api[_-]?key)(?:\"|'')?\\s*[=:]\\s*"
                     "(?:\"[^\"]*\"|''[^'']*''|[^,\\s}]+)")


@query("redact_payloads", f"""WITH {S_TEXTS}, y AS (SELECT *, regexp_replace(text, '{S_PAYLOAD_PATTERN}', '\\1=[REDACTED]', 'g') AS s FROM x),
z AS (SELECT *, hex(encode(s)) AS h FROM y)
SELECT kind, id, turn, 'utf-8' AS encoding, {s_cut('value', '200')}, length(h) > 400 AS truncated FROM z""")
def redact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = V.texts(spark, sf_dir).select("kind", "id", "turn", redact_payload(F.col("text"), 200).alias("p"))
    return cut.select("kind", "id", "turn", F.col("p.encoding").alias("encoding"), F.col("p.value").alias("value"),
                      F.col("p.truncated").alias("truncated"))


@query("binary_payloads", f"""WITH {S_TEXTS} SELECT kind, id, turn, base64(unhex(substr(hex(encode(text)), 1, 200))) AS value,
  octet_length(encode(text)) > 100 AS truncated FROM x""")
def binary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = V.texts(spark, sf_dir).select("kind", "id", "turn", binary_payload(F.encode("text", "UTF-8"), 100).alias("p"))
    return cut.select("kind", "id", "turn", F.col("p.value").alias("value"), F.col("p.truncated").alias("truncated"))


@query("payload_previews", f"""WITH {S_TEXTS}, y AS (SELECT *, regexp_replace(text, '{S_PAYLOAD_PATTERN}', '\\1=[REDACTED]', 'g') AS s FROM x),
z AS (SELECT *, hex(encode(s)) AS h FROM y), c AS (SELECT *, {s_cut('cut', '4100')} FROM z)
SELECT kind, id, turn, substr(cut, 1, 4096) AS preview, length(h) > 8200 OR length(cut) > 4096 AS truncated FROM c""")
def payload_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = V.texts(spark, sf_dir).select("kind", "id", "turn", redact_payload(F.col("text"), 4100).alias("p"))
    shown = cut.select("kind", "id", "turn", payload_preview(F.col("p")).alias("v"))
    return shown.select("kind", "id", "turn", F.col("v.value").alias("preview"), F.col("v.truncated").alias("truncated"))


# -- sequences and orders ---------------------------------------------------------------------

S_SEQ = """e AS (SELECT 'user/' || user_id AS source, event_id AS arrival,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
q AS (SELECT source, arrival, greatest(n + arrival // 700 - CASE WHEN arrival % 11 = 0 THEN 1 ELSE 0 END
  - CASE WHEN arrival % 13 = 0 THEN 2 ELSE 0 END, 1) AS sequence FROM e)"""


def s_status(prior: str = "l") -> str:
    return f"""source, arrival, sequence, CASE WHEN {prior} IS NULL THEN CASE WHEN sequence = 1 THEN 'EXPECTED' ELSE 'GAP_DETECTED' END
  WHEN sequence = {prior} + 1 THEN 'EXPECTED' WHEN sequence > {prior} + 1 THEN 'GAP_DETECTED' WHEN sequence = {prior} THEN 'DUPLICATE'
  ELSE 'LATE_OR_OUT_OF_ORDER' END AS status, coalesce({prior}, 0) + 1 AS expected,
  greatest(sequence - coalesce({prior}, 0) - 1, 0) AS missing"""


S_CLASSED = f"""{S_SEQ}, w AS (SELECT *, max(sequence) OVER (PARTITION BY source ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM q), c AS (SELECT {s_status()} FROM w)"""


@query("sequence_integrity", f"WITH {S_CLASSED} SELECT * FROM c")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_integrity(V.sequences(spark, sf_dir))


@query("sequence_counters", f"""WITH {S_CLASSED} SELECT source, sum(CASE WHEN status = 'GAP_DETECTED' THEN missing ELSE 0 END)::BIGINT AS gaps,
  count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicates FROM c GROUP BY source""")
def integrity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence_counters(sequence_integrity(V.sequences(spark, sf_dir)))
    return out.select("source", F.col("sequence_gap_count").cast("bigint").alias("gaps"),
                      F.col("duplicate_count").alias("duplicates"))


@query("sequence_strict", f"""WITH {S_SEQ} SELECT source, arrival, sequence, l AS previous, l IS NULL OR sequence > l AS accepted FROM (
  SELECT *, max(sequence) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM q)""")
def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_strict(V.sequences(spark, sf_dir))


@query("sequence_reset", f"""WITH {S_SEQ}, r AS (SELECT *, sum(CASE WHEN arrival % 400 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source
  ORDER BY arrival) AS epoch FROM q), w AS (SELECT *, max(sequence) OVER (PARTITION BY source, epoch ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM r) SELECT {s_status()} FROM w""")
def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = V.sequences(spark, sf_dir).withColumn("forget", F.col("arrival") % 400 == 0)
    return sequence_integrity(marked, reset="forget").drop("forget")


S_ORDERS = f"""r AS (SELECT o_orderkey AS order_id, 'ORDER_ADDED' AS kind, epoch_us(o_orderdate) * 1000 AS arrival, 0 AS rank, 0 AS line,
  0::BIGINT AS part, 0::BIGINT AS supplier, 80::BIGINT AS quantity, {s_cents('o_totalprice')} AS cents, 0.0::DOUBLE AS discount,
  0.0::DOUBLE AS tax, '' AS flag, '' AS line_status, {S_CSYM} AS symbol FROM orders
  UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'ORDER_CANCELLED' ELSE 'ORDER_EXECUTED' END,
  epoch_us(l_shipdate) * 1000, 1, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), {s_cents('l_extendedprice')},
  l_discount, l_tax, l_returnflag, l_linestatus, NULL FROM lineitem),
g AS (SELECT *, sum(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER w AS gen FROM r WINDOW w AS (PARTITION BY order_id ORDER BY
  {', '.join(V.ORDER_TIES)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, sum(CASE WHEN rank = 0 THEN quantity ELSE -quantity END) OVER w AS before, max(symbol) OVER w AS owner FROM g
  WINDOW w AS (PARTITION BY order_id, gen ORDER BY {', '.join(V.ORDER_TIES)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN gen > 0 AND before > 0 THEN before::BIGINT END AS remaining, CASE WHEN gen > 0 AND before > 0 THEN owner END AS open_symbol FROM s)"""


@query("order_state", f"WITH {S_ORDERS} SELECT order_id, kind, arrival, line, part, supplier, quantity, cents, remaining, open_symbol FROM o")
def orders_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_state(V.order_rows(spark, sf_dir), order=V.ORDER_TIES).select(
        "order_id", "kind", "arrival", "line", "part", "supplier", "quantity", "cents", "remaining", "open_symbol")


@query("resolve_instruments", f"""WITH {S_ORDERS} SELECT order_id, kind, arrival, line, part, supplier, quantity, cents,
  CASE WHEN rank = 0 THEN symbol ELSE open_symbol END AS instrument,
  CASE WHEN rank = 1 AND open_symbol IS NULL THEN 'INSTRUMENT_NOT_RESOLVED' END AS resolve_error FROM o""")
def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_instruments(V.order_rows(spark, sf_dir), order=V.ORDER_TIES).select(
        "order_id", "kind", "arrival", "line", "part", "supplier", "quantity", "cents", "instrument", "resolve_error")


def end_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sequences(spark, sf_dir).withColumn("sequence", F.when(F.col("arrival") % 29 == 0, F.lit(MAX_LONG)).otherwise(F.col("sequence")))


@query("sequence_end_of_range", f"""WITH {S_SEQ}, x AS (SELECT source, arrival, CASE WHEN arrival % 29 = 0 THEN {MAX_LONG} ELSE sequence END AS sequence FROM q),
w AS (SELECT *, max(sequence) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM x),
z AS (SELECT *, CASE WHEN l IS NULL THEN 1 WHEN l < {MAX_LONG} THEN l + 1 END AS expected FROM w)
SELECT source, arrival, sequence, CASE WHEN expected IS NULL AND sequence = l THEN 'DUPLICATE' WHEN expected IS NULL THEN 'LATE_OR_OUT_OF_ORDER'
  WHEN sequence = expected THEN 'EXPECTED' WHEN sequence > expected THEN 'GAP_DETECTED' WHEN sequence = l THEN 'DUPLICATE' ELSE 'LATE_OR_OUT_OF_ORDER' END AS status,
  expected, CASE WHEN sequence > expected THEN sequence - expected ELSE 0 END AS missing FROM z""")
def sequence_end_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_integrity(end_of_range(spark, sf_dir))


def through_stream(spark: SparkSession, table: DataFrame, apply: Callable[[DataFrame], DataFrame], at: str = "arrival",
                   batches: int = 4) -> DataFrame:
    """Stream a table through ``apply`` in ``batches`` ranges of arrival, and read the result back.

    Each range is a run of the query of its own that goes on from the checkpoint, so state crosses micro-batches and restarts.
    Rows that arrive at the same time are in one range.
    """
    whole, path, out, mark = (V.scratch(spark, n) for n in ("stream-whole", "stream-in", "stream-out", "stream-state"))
    table.write.parquet(whole)
    saved = spark.read.schema(table.schema).parquet(whole)
    ends = saved.approxQuantile(at, [i / batches for i in range(1, batches)], 0.01)
    borders = [None, *sorted({int(e) for e in ends}), None]
    for low, high in zip(borders, borders[1:]):
        part = saved if low is None else saved.filter(F.col(at) > low)
        (part if high is None else part.filter(F.col(at) <= high)).write.mode("append").parquet(path)
        apply(spark.readStream.schema(table.schema).parquet(path)).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("sequence_stream", f"WITH {S_CLASSED} SELECT * FROM c")
def sequence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_stream(spark, V.sequences(spark, sf_dir), sequence_integrity_stream)


@query("order_stream", f"WITH {S_ORDERS} SELECT order_id, kind, arrival, line, part, supplier, quantity, cents, remaining, open_symbol FROM o")
def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = through_stream(spark, V.order_rows(spark, sf_dir), lambda s: order_state_stream(s, order=V.ORDER_TIES))
    return out.select("order_id", "kind", "arrival", "line", "part", "supplier", "quantity", "cents", "remaining", "open_symbol")


# -- reports ----------------------------------------------------------------------------------

S_STATE = f"""{S_MIXED}, t AS (SELECT *, CASE WHEN aggressor IS NULL THEN 'FAILED' WHEN qty > 40 THEN 'FILTERED'
  WHEN cents % 10 <> 0 THEN 'FAILED' ELSE 'EMITTED' END AS state FROM m), n AS (SELECT count(*) AS received, count(*) AS parsed, count(*) AS normalized,
  count(*) FILTER (WHERE state = 'FILTERED') AS filtered, count(*) FILTER (WHERE state = 'EMITTED') AS emitted,
  count(*) FILTER (WHERE state = 'FAILED') AS failed FROM t)"""


@query("run_counters", f"WITH {S_STATE} SELECT * FROM n")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_counters(process_events(V.mixed(spark, sf_dir), RULES))


@query("run_outcome", f"WITH {S_STATE} SELECT emitted, failed, 'COMPLETED' AS outcome FROM n UNION ALL SELECT emitted, failed, 'FAILED' FROM n")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = run_counters(process_events(V.mixed(spark, sf_dir), RULES))
    both = run_outcome(counted, "QUARANTINE").unionByName(run_outcome(counted, "FAIL_FAST"))
    return both.select("emitted", "failed", "outcome")


@query("event_rate", """
WITH h AS (SELECT event_type AS run, date_trunc('hour', ts) AS hour, max(epoch_us(ts)) * 1000 AS at_ns, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT run, at_ns, sum(n) OVER (PARTITION BY run ORDER BY hour) AS received FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY at_ns DESC) AS rn FROM c),
s AS (SELECT run, count(*) AS n, min(at_ns) AS a, max(at_ns) AS b, min(received) AS x, max(received) AS y FROM r WHERE rn <= 120 GROUP BY run)
SELECT run, CASE WHEN n < 2 OR b <= a THEN 0 ELSE ((y - x)::HUGEINT * 1000000000 // (b - a))::BIGINT END AS events_per_second FROM s""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rate(V.run_samples(spark, sf_dir))


@query("event_rate_scaled", """
WITH h AS (SELECT event_type AS run, date_trunc('hour', ts) AS hour, max(epoch_us(ts)) * 1000 AS at_ns, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT run, at_ns, sum(n) OVER (PARTITION BY run ORDER BY hour) * 1000000 AS received FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY at_ns DESC) AS rn FROM c),
s AS (SELECT run, count(*) AS n, min(at_ns) AS a, max(at_ns) AS b, min(received) AS x, max(received) AS y FROM r WHERE rn <= 20 GROUP BY run)
SELECT run, CASE WHEN n < 2 OR b <= a THEN 0 ELSE ((y - x)::HUGEINT * 1000000000 // (b - a))::BIGINT END AS events_per_second FROM s""")
def scaled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = V.run_samples(spark, sf_dir).withColumn("received", F.col("received") * 1000000)
    return event_rate(samples, last=20)


@query("duration_average", f"""SELECT event_type, (sum({s_cents('value')}) // count(*))::BIGINT AS average FROM events GROUP BY event_type""")
def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.table(spark, sf_dir, "events").select("event_type", V.cents("value").alias("nanos"))
    return duration_average(df, "nanos", ["event_type"])


@query("latest_per_key", """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return latest_per_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# -- documents --------------------------------------------------------------------------------

KEYS = ["userPassword", "plain", "apiKey", "API_KEY", "session_token", "name", "clientSecret", "credentials"]


@query("credential_keys", f"""
WITH k AS (SELECT doc_id, {KEYS!r}[(doc_id % 8 + 1)::INTEGER] AS a, {KEYS!r}[((doc_id // 8) % 8 + 1)::INTEGER] AS b FROM documents)
SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter([a, b], lambda x: regexp_matches(lower(x), 'password|secret|token|api_key|apikey|credential')))), ',') AS keys FROM k
UNION ALL SELECT -1 - event_id, '' FROM events""")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KEYS])
    a = F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int"))
    b = F.element_at(names, (F.call_function("div", F.col("doc_id"), F.lit(8).cast("bigint")) % 8 + 1).cast("int"))
    docs = V.spread(V.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.concat(
        F.lit('{"note":'), json_string(F.concat(F.lit('"password": '), F.col("text"))), F.lit(',"'), a,
        F.lit('":[{"'), b, F.lit('":1},2]}')).alias("doc"))
    events = V.table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), F.col("props").alias("doc"))
    found = find_credential_keys(docs.unionByName(events), "doc")
    return found.select("id", F.array_join("credential_keys", ",").alias("keys"))


@query("document_check", """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'document must be a JSON object'
  WHEN 2 THEN 'document.$schema is required to identify the JSON Schema dialect'
  WHEN 3 THEN 'document.$schema is required to identify the JSON Schema dialect'
  WHEN 4 THEN 'document.$schema is required to identify the JSON Schema dialect'
  WHEN 5 THEN 'document is required' WHEN 6 THEN 'document must be a JSON object' END AS issue FROM documents""")
def documents_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id") % 7, json_string(F.col("text"))
    doc = (F.when(k == 1, F.concat(F.lit("["), text, F.lit("]")))
           .when(k == 2, F.concat(F.lit('{"title":'), text, F.lit("}")))
           .when(k == 3, F.concat(F.lit('{"$schema":"  ","title":'), text, F.lit("}")))
           .when(k == 4, F.concat(F.lit('{"$schema":5,"title":'), text, F.lit("}")))
           .when(k == 5, F.lit("null")).when(k == 6, F.lit("not json"))
           .otherwise(F.concat(F.lit('{"$schema":"https://json-schema.org/draft/2020-12/schema","title":'), text, F.lit("}"))))
    df = V.spread(V.table(spark, sf_dir, "documents")).select("doc_id", doc.alias("doc"))
    return check_document(df, "doc").select("doc_id", F.col("document_issue").alias("issue"))


# -- sinks ------------------------------------------------------------------------------------

@query("jsonl_roundtrip", f"""SELECT o_orderkey AS id, {S_CSYM} AS symbol, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_ns,
  {s_plain(s_cents('o_totalprice') + ' * 100', 4)} AS price, {S_SIDE} AS side FROM orders""")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.scale_decimal(V.adds(spark, sf_dir), "payload.price", 4)
    path = V.scratch(spark, "jsonl")
    write_jsonl(B.render_blueprint(df, RENDER), path)
    back = spark.read.schema("who string, side array<string>, made struct<at string, cost string, `order` bigint>").json(path)
    return back.select(F.col("made.order").alias("id"), F.col("who").alias("symbol"), F.col("made.at").alias("at_ns"),
                       F.col("made.cost").alias("price"), F.get("side", F.lit(0)).alias("side"))


TRADE_COLUMNS = [("time", "metadata.exchangeTimestamp"), ("symbol", "instrument.symbol"), ("place", "metadata.venue"),
                 ("price", "payload.price"), ("size", "payload.quantity"), ("direction", "payload.aggressorSide")]
TRADE_CONFIG = CsvConfig(
    source="csv/roundtrip", timestamp_column="time", symbol_column="symbol", venue_column="place",
    decimal_price_column="price", quantity_column="size", side_column="direction",
    side_mapping={"BUY": "BUY", "SELL": "SELL"}, price_scale=2)


@query("csv_roundtrip", f"""SELECT epoch_us(l_shipdate) * 1000 AS at_ns, {S_PSYM} AS symbol, {s_cents('l_extendedprice')} AS cents,
  CAST(l_quantity AS BIGINT) AS quantity, CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' END AS side,
  CASE WHEN l_returnflag = 'N' THEN 'INVALID_SIDE' END AS reason FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'INVALID_SIDE' FROM lineitem WHERE l_returnflag = 'N'""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = V.scratch(spark, "csv")
    write_csv(V.trades(spark, sf_dir), path, TRADE_COLUMNS)
    events, errors = read_trades_csv(spark, path, TRADE_CONFIG, quoted_line_breaks=False)
    good = events.select(
        F.col("metadata.exchangeTimestamp").alias("at_ns"), F.col("instrument.symbol").alias("symbol"),
        F.col("payload.price.mantissa").alias("cents"), F.col("payload.quantity").alias("quantity"),
        F.col("payload.aggressorSide").alias("side"), F.lit(None).cast("string").alias("reason"))
    null = F.lit(None)
    return good.unionByName(errors.select(
        null.cast("bigint").alias("at_ns"), null.cast("string").alias("symbol"), null.cast("bigint").alias("cents"),
        null.cast("bigint").alias("quantity"), null.cast("string").alias("side"), "reason"))


# -- whole runs -------------------------------------------------------------------------------

def feed_run(spark: SparkSession, sf_dir: str, output: str, policy: str, letters: str | None = None,
             kind: Kind = renamed, max_bytes: int = 40, files: str | None = None) -> Report:
    """One run over the event files, those in ``files`` if given: rows above a quantity are emitted."""
    config = DeadLetterConfig(policy, include_payload=True, max_bytes=max_bytes)
    return run(read_jsonl_input(spark, f"{files or event_files(spark, sf_dir)}/file=*"), output, FEED_RULES, config=config,
               dead_letter_path=letters, kind=kind, pipeline_id="feed", pipeline_version="2")


def report_rows(spark: SparkSession, report: Report, **more: object) -> DataFrame:
    """A report as (name, value) rows; it has a fixed, small number of them."""
    found = {**report.counters, "outcome": report.outcome, "retained": len(report.failures), "suppressed": report.suppressed, **more}
    return spark.createDataFrame([(n, str(v)) for n, v in found.items()], "name string, value string")


def s_report(source: str, outcome: str, failed_more: int = 0, **more: str) -> str:
    """SQL of ``report_rows`` over ``source``, rows with a state; ``more`` are SQL texts by name."""
    parts = {"received": "count(*)", "parsed": "count(*) FILTER (WHERE state <> 'PARSE_FAILED')",
             "normalized": "count(*) FILTER (WHERE state <> 'PARSE_FAILED')",
             "filtered": "count(*) FILTER (WHERE state = 'FILTERED')", "emitted": "count(*) FILTER (WHERE state = 'EMITTED')",
             "failed": f"(count(*) FILTER (WHERE state = 'PARSE_FAILED') + {failed_more})"}
    rows = [f"SELECT '{n}' AS name, {x}::VARCHAR AS value FROM {source}" for n, x in parts.items()]
    rows.append(f"SELECT 'retained', least({parts['failed']}, 100)::VARCHAR FROM {source}")
    rows.append(f"SELECT 'suppressed', greatest({parts['failed']} - 100, 0)::VARCHAR FROM {source}")
    rows += [f"SELECT '{n}', ({x})::VARCHAR" for n, x in {"outcome": f"'{outcome}'", **more}.items()]
    return " UNION ALL ".join(rows)


S_EMITTED = "SELECT count(*) FROM s WHERE state = 'EMITTED'"


@query("run_skip", f"WITH {S_FEED} " + s_report("s", "COMPLETED", published=S_EMITTED))
def run_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.scratch(spark, "run-out")
    report = feed_run(spark, sf_dir, out, SKIP)
    return report_rows(spark, report, published=spark.read.text(out).count())


@query("run_fail_fast", f"""WITH {S_FEED}, w AS (SELECT state, event_id, min(CASE WHEN state = 'PARSE_FAILED' THEN event_id END) OVER (PARTITION BY event_id % 5) AS stop FROM s),
c AS (SELECT * FROM w WHERE stop IS NULL OR event_id <= stop) """ + s_report("c", "FAILED", published=S_EMITTED, versions="1"))
def run_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends at the first failure of each file, over the output of an earlier run, which stays current."""
    out, files = V.scratch(spark, "run-out"), event_files(spark, sf_dir)
    feed_run(spark, sf_dir, out, SKIP, kind=versioned, files=files)
    report = feed_run(spark, sf_dir, out, FAIL_FAST, kind=versioned, files=files)
    return report_rows(spark, report, published=spark.read.text(current_path(spark, out)).count(), versions=len(versions(spark, out)))


@query("run_output", f"""WITH {S_FEED} SELECT e.event_id, e.event_id % 97 + 1 AS quantity, upper(event_type) AS symbol, {s_cents('value')} AS cents
FROM events e JOIN s USING (event_id) WHERE state = 'EMITTED'""")
def run_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, letters = V.scratch(spark, "run-out"), V.scratch(spark, "run-letters")
    feed_run(spark, sf_dir, out, QUARANTINE, letters, versioned)
    event = "metadata struct<sequenceNumber bigint>, instrument struct<symbol string>, payload struct<quantity bigint, price decimal(20,2)>"
    return spark.read.schema(event).json(current_path(spark, out)).select(
        (F.col("metadata.sequenceNumber") - 1).alias("event_id"), F.col("payload.quantity").alias("quantity"),
        F.col("instrument.symbol").alias("symbol"), (F.col("payload.price") * 100).cast("bigint").alias("cents"))


@query("run_payloads", f"""WITH e AS (SELECT *, event_id % 23 AS k, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS line,
  {s_event_id("('user/' || user_id)", 'event_id + 1')} AS hash FROM events), r AS (SELECT *, {S_LINE_REASON} AS reason FROM e),
t AS (SELECT *, CASE k WHEN 21 THEN '  ' WHEN 22 THEN 'not-json' ELSE CASE k WHEN 1 THEN '{{"extra":1,' ELSE '{{' END || '"metadata":{{"eventId":"' ||
  CASE k WHEN 2 THEN repeat('0', 64) ELSE hash END END AS text FROM r WHERE reason IS NOT NULL)
SELECT event_id % 5 AS file, line, 'PARSE' AS stage, 'MALFORMED_INPUT' AS category, 'NON_RETRYABLE' AS retryability, reason,
  substr(text, 1, 40) AS payload, length(text) > 40 AS truncated FROM t""")
def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of a run with the beginning of each bad line."""
    out, letters = V.scratch(spark, "run-out"), V.scratch(spark, "run-letters")
    feed_run(spark, sf_dir, out, QUARANTINE, letters)
    place = [F.regexp_extract("sourceLocation", pattern, 1) for pattern in ("/file=([0-9]+)/", r":line ([0-9]+)\z")]
    return read_dead_letters(spark, letters).select(
        place[0].cast("bigint").alias("file"), place[1].cast("bigint").alias("line"), "stage", "category", "retryability",
        F.substring_index("safeMessage", ":", 1).alias("reason"), F.col("payload.value").alias("payload"),
        F.col("payload.truncated").alias("truncated"))


@query("run_sink_failure", f"WITH {S_FEED} " + s_report(
    "s", "FAILED", 1, published="'none'", letters="SELECT count(*) + 1 FROM s WHERE state = 'PARSE_FAILED'", retryable="1"))
def run_sink_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose output folder cannot be made, since a file is in its place: quarantined, reported and ended as failed."""
    base, letters = V.scratch(spark, "run-blocked"), V.scratch(spark, "run-letters")
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(place)
    report = feed_run(spark, sf_dir, f"{base}/out", QUARANTINE, letters, versioned)
    quarantined = read_dead_letters(spark, current_path(spark, letters))
    output = quarantined.filter((F.col("stage") == "OUTPUT") & (F.col("category") == "OUTPUT") & (F.col("retryability") == "RETRYABLE"))
    return report_rows(spark, report, published="none", letters=quarantined.count(), retryable=output.count())


def order_lines(spark: SparkSession, sf_dir: str, path: str, times: int) -> None:
    """Publish a version of one line per order: its key and total, ``times`` over."""
    lines = V.table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", (V.cents("o_totalprice") * times)).alias("value"))
    publish(spark, path, lambda to: lines.write.text(to), versioned)


def order_totals(spark: SparkSession, path: str, version: str) -> DataFrame:
    line = F.split("value", ",")
    return spark.read.text(path).select(F.lit(version).alias("version"), line[0].cast("bigint").alias("o_orderkey"), line[1].cast("bigint").alias("total"))


@query("publish_replace", f"""SELECT 'held' AS version, o_orderkey, {s_cents('o_totalprice')} * 2 AS total FROM orders
UNION ALL SELECT 'current', o_orderkey, {s_cents('o_totalprice')} * 3 FROM orders""")
def publish_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of one output: the reader of the second goes on while the third is current; the first is gone."""
    path = V.scratch(spark, "published")
    order_lines(spark, sf_dir, path, 1)
    order_lines(spark, sf_dir, path, 2)
    held = current_path(spark, path)
    order_lines(spark, sf_dir, path, 3)
    return order_totals(spark, held, "held").unionByName(order_totals(spark, current_path(spark, path), "current"))


@query("publish_abort", f"SELECT 'current' AS version, o_orderkey, {s_cents('o_totalprice')} AS total, 1 AS versions FROM orders")
def publish_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version whose job fails on its last order is thrown away; the one before stays current."""
    path = V.scratch(spark, "published")
    order_lines(spark, sf_dir, path, 1)
    orders = V.table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    broken = orders.select(F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("value"))
    try:
        publish(spark, path, lambda to: broken.write.text(to), versioned)
    except PySparkException:
        pass
    return order_totals(spark, current_path(spark, path), "current").withColumn("versions", F.lit(len(versions(spark, path))))


@query("redact_whole_texts", f"""WITH {S_TEXTS} SELECT kind, id, turn,
  sha256(regexp_replace(text, '{S_PAYLOAD_PATTERN}', '\\1=[REDACTED]', 'g')) AS digest FROM x""")
def redact_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction of whole texts, far behind any cut, told by a digest."""
    safe = redact_payload(F.col("text"), (1 << 31) - 1)
    return V.texts(spark, sf_dir).select("kind", "id", "turn", F.sha2(safe["value"], 256).alias("digest"))
