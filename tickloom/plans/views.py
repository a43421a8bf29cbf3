"""Event views over the given tables: each reads whole tables and plants faults by rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.functions.fixed import fixed
from tickloom.functions.ids import event_id
from tickloom.functions.jsontext import json_string
from tickloom.functions.times import iso_utc
from tickloom.operators.orders import ADD, CANCEL, EXECUTE
from tickloom.schema import EVENT_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share a scan of few row groups among all cores before CPU-bound expressions.

    Only a scan with fewer partitions than the cluster has cores is shuffled, so a large table never
    is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the checkpoint folder that all executors share; a local session without one gets one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cents(column: str) -> Column:
    return (F.col(column).cast("decimal(18,2)") * 100).cast("bigint")


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def metadata(source: Column, sequence: Column, venue: Column, at: Column, reference: Column) -> Column:
    return F.struct(
        event_id(source, sequence).alias("eventId"),
        F.struct(F.lit(1).cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor"))
        .alias("schemaVersion"),
        source.alias("source"), venue.alias("venue"), at.alias("exchangeTimestamp"),
        F.lit(None).cast("bigint").alias("receiveTimestamp"), sequence.cast("bigint").alias("sequenceNumber"),
        reference.alias("rawEventReference"))


def payload(**given: Column) -> Column:
    types = {f.name: f.dataType for f in EVENT_SCHEMA["payload"].dataType.fields}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def instrument(symbol: Column) -> Column:
    return F.struct(symbol.alias("symbol"))


def customer_symbol() -> Column:
    return F.concat(F.lit("C"), F.conv(F.col("o_custkey").cast("string"), 10, 36))


def part_symbol() -> Column:
    return F.concat(F.lit("P"), F.conv(F.col("l_partkey").cast("string"), 10, 36))


def order_side() -> Column:
    return F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL")


def adds(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """ORDER_ADDED events, one per order."""
    key = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", *extra,
        metadata(F.lit("orders"), key + 1, F.lit("XTPC"), nanos("o_orderdate"),
                 F.concat(F.lit("orders:"), key.cast("string"))).alias("metadata"),
        instrument(customer_symbol()).alias("instrument"),
        payload(type=F.lit(ADD), orderId=key, side=order_side(), quantity=F.lit(80),
                price=fixed(cents("o_totalprice"), 2)).alias("payload"))


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRADE events, one per line item; the aggressor is absent for return flag N."""
    flag = F.col("l_returnflag")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return spread(table(spark, sf_dir, "lineitem")).select(
        *LINE_KEY,
        metadata(F.lit("lineitem"), number, F.lit("XTPC"), nanos("l_shipdate"),
                 F.concat(F.lit("lineitem:"), number.cast("string"))).alias("metadata"),
        instrument(part_symbol()).alias("instrument"),
        payload(type=F.lit("TRADE"), tradeId=number,
                aggressorSide=F.when(flag == "A", "BUY").when(flag == "R", "SELL"),
                quantity=F.col("l_quantity").cast("bigint"),
                price=fixed(cents("l_extendedprice"), 2)).alias("payload"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds and trades together, so that some fields exist in some rows only."""
    zero = F.lit(0).cast("bigint")
    return adds(spark, sf_dir).select(
        F.col("o_orderkey").alias("k1"), zero.alias("k2"), zero.alias("k3"), zero.alias("k4"), "metadata",
        "instrument", "payload").unionByName(trades(spark, sf_dir).select(
            F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("bigint").alias("k2"),
            F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), "metadata", "instrument", "payload"))


# Faults planted in orders by key modulo 25: which field gets which value.
def faulty_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 25

    def swap(at: int, bad: Column | str | None, good: Column) -> Column:
        bad = bad if isinstance(bad, Column) else F.lit(bad)
        return F.when(k == at, bad).otherwise(good)

    m, p = F.col("metadata"), F.col("payload")
    base = adds(spark, sf_dir, ("o_orderpriority", "o_orderdate"))
    meta = (m.withField("venue", swap(1, "bad venue", F.when(k == 14, F.lit("xtpc")).otherwise(m["venue"])))
            .withField("eventId", swap(2, "0" * 64, swap(3, "XYZ", m["eventId"])))
            .withField("schemaVersion", F.struct(
                F.lit(1).cast("bigint").alias("major"), swap(4, F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
                .alias("minor")))
            .withField("source", swap(5, "-orders", m["source"]))
            .withField("rawEventReference", swap(6, "has space", m["rawEventReference"]))
            .withField("exchangeTimestamp", swap(7, F.lit(-1).cast("bigint"), m["exchangeTimestamp"])))
    pay = (p.withField("type", swap(8, "FOO", p["type"]))
           .withField("quantity", swap(9, F.lit(0).cast("bigint"), p["quantity"]))
           .withField("side", swap(10, "B", p["side"]))
           .withField("price", swap(11, fixed(F.lit(1), 19), swap(12, F.lit(None).cast("struct<mantissa:bigint,scale:int>"), p["price"]))))
    symbol = F.col("instrument.symbol")
    inst = instrument(swap(13, "A B", F.when(k == 14, F.rpad(symbol, 8, " ")).otherwise(symbol)))
    return base.select("o_orderkey", "o_orderpriority", "o_orderdate", meta.alias("metadata"),
                       inst.alias("instrument"), pay.alias("payload"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers per user with gaps, duplicates and late rows.

    The numbers are planted by a plain window; the operators under test are what splits a large user.
    """
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_id").alias("arrival"))
    counted = events.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("arrival")).cast("bigint"))
    at = F.col("arrival")
    number = (F.col("n") + F.call_function("div", at, F.lit(700).cast("bigint"))
              - F.when(at % 11 == 0, 1).otherwise(0) - F.when(at % 13 == 0, 2).otherwise(0))
    return counted.select("source", "arrival", F.greatest(number, F.lit(1)).alias("sequence"))


ORDER_TIES = ["arrival", "rank", "line", "part", "supplier", "quantity", "cents", "discount", "tax",
              "flag", "line_status"]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds from orders, Executes and Cancels from line items, with a total order per order id."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("order_id"), F.lit(ADD).alias("kind"),
        nanos("o_orderdate").alias("arrival"), F.lit(0).alias("rank"), F.lit(0).alias("line"),
        F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("supplier"),
        F.lit(80).cast("bigint").alias("quantity"), cents("o_totalprice").alias("cents"),
        F.lit(0.0).alias("discount"), F.lit(0.0).alias("tax"), F.lit("").alias("flag"),
        F.lit("").alias("line_status"), customer_symbol().alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("orders").alias("source"), F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", CANCEL).otherwise(EXECUTE).alias("kind"),
        nanos("l_shipdate").alias("arrival"), F.lit(1).alias("rank"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").cast("bigint").alias("quantity"), cents("l_extendedprice").alias("cents"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
        F.lit(None).cast("string").alias("symbol"))
    return orders.unionByName(lines)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON lines of trades from events, with one fault kind per id modulo 23."""
    e = spread(table(spark, sf_dir, "events"))
    k, key = F.col("event_id") % 23, F.col("event_id")
    source = F.concat(F.lit("user/"), F.col("user_id").cast("string"))

    def pick(good: Column | str, **faults: str) -> Column:
        out = None
        for at, text in faults.items():
            hit = k == int(at[1:])
            out = F.when(hit, text) if out is None else out.when(hit, text)
        good = good if isinstance(good, Column) else F.lit(good)
        return good if out is None else out.otherwise(good)

    number = (key + 1).cast("string")
    quantity = (key % 97 + 1).cast("string")
    line = F.concat(
        F.lit("{"), pick("", _1='"extra":1,'),
        F.lit('"metadata":{"eventId":'), json_string(F.when(k == 2, "0" * 64).otherwise(event_id(source, key + 1))),
        F.lit(',"schemaVersion":{"major":1,"minor":'), pick("0", _3="1"), F.lit('},"source":'), json_string(source),
        F.lit(',"venue":'), pick('"xtpc"', _4='"x tpc"', _5="null"),
        F.lit(',"exchangeTimestamp":'), F.when(k == 6, F.lit('"7"')).otherwise(nanos("ts").cast("string")),
        F.lit(',"sequenceNumber":'), F.when(k == 7, F.lit("1.0")).otherwise(number),
        F.lit(',"rawEventReference":'), json_string(F.concat(F.lit("events:"), key.cast("string"))),
        F.lit('},"instrument":{"symbol":"'), pick(F.upper("event_type"), _8="TOO LONG1"),
        F.lit('"},"payload":{"type":"'), pick("TRADE", _9="NOPE"), F.lit('","tradeId":'), key.cast("string"),
        pick(',"aggressorSide":"BUY"', _10=',"aggressorSide":"X"', _11="", _12=',"aggressorSide":null'),
        F.lit(',"quantity":'), F.when(k == 13, F.concat(quantity, F.lit(".0"))).when(k == 14, F.concat(F.lit('"'), quantity, F.lit('"')))
        .when(k == 15, F.lit("0")).otherwise(quantity),
        F.lit(',"price":{"mantissa":'), F.when(k == 16, F.lit("99999999999999999999")).otherwise(cents("value").cast("string")),
        F.lit(',"scale":'), pick("2", _17="19"), F.lit("}"), pick("", _18=',"note":"x"'), F.lit("}}"),
        pick("", _19=" {}", _20="]"))
    text = F.when(k == 21, F.lit("  ")).when(k == 22, F.lit("not-json")).otherwise(line)
    return e.select("event_id", "user_id", text.alias("value"))


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON lines of quotes from events: none, one or both sides, and faults in the ask, by id modulo 6."""
    key, k = F.col("event_id"), F.col("event_id") % 6
    source = F.concat(F.lit("quotes/"), F.col("user_id").cast("string"))

    def level(name: str, mantissa: Column, quantity: Column, price: Column | None = None) -> Column:
        shown = F.concat(F.lit('"price":{"mantissa":'), mantissa.cast("string"), F.lit(',"scale":2},"quantity":'), quantity)
        return F.concat(F.lit(f',"{name}":{{'), shown if price is None else F.when(price, shown).otherwise('"quantity":3'), F.lit("}"))

    bid = F.when(k.isin(1, 3), level("bid", cents("value"), F.lit("7")))
    ask = F.when(k.isin(2, 3, 4, 5), level("ask", cents("value") + 1, F.when(k == 4, "0").otherwise("9"), k != 5))
    line = F.concat(
        F.lit('{"metadata":{"eventId":'), json_string(event_id(source, key + 1)), F.lit(',"schemaVersion":{"major":1,"minor":0},"source":'),
        json_string(source), F.lit(',"venue":"XTPC","exchangeTimestamp":'), nanos("ts").cast("string"), F.lit(',"sequenceNumber":'),
        (key + 1).cast("string"), F.lit(',"rawEventReference":"q"},"instrument":{"symbol":"Q"},"payload":{"type":"QUOTE"'),
        F.coalesce(bid, F.lit("")), F.coalesce(ask, F.lit("")), F.lit("}}"))
    return spread(table(spark, sf_dir, "events")).select("event_id", line.alias("value"))


def hex_long(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), width * 2, "0")


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add frames from orders and Execute / Cancel frames from line items, faults by order key."""
    k, key = F.col("o_orderkey") % 20, F.col("o_orderkey")
    body = F.concat(
        F.when(k == 1, "5A").otherwise("41"),
        F.when(k == 2, F.lit("8000000000000001")).otherwise(hex_long(key + 1, 8)),
        hex_long(nanos("o_orderdate"), 8), hex_long(key, 8),
        F.hex(F.encode(F.rpad(F.when(k == 3, F.lit("A B")).otherwise(customer_symbol()), 8, " "), "US-ASCII")),
        F.when(k == 4, "58").otherwise(F.when(key % 2 == 0, "42").otherwise("53")),
        F.when(k == 5, F.lit("00000000")).otherwise(hex_long(F.lit(80), 4)),
        hex_long(cents("o_totalprice"), 8), F.when(k == 6, "13").otherwise("02"))
    text = (F.when(k == 7, F.concat(F.lit("002F"), F.substring(body, 1, 92)))
            .when(k == 8, F.concat(F.lit("002F"), body, F.lit("00")))
            .when(k == 9, F.lit("0000")).when(k == 10, F.lit("00"))
            .when(k == 11, F.concat(F.lit("0030"), body, F.lit("00")))
            .otherwise(F.concat(F.lit("002F"), body)))
    add = spread(table(spark, sf_dir, "orders")).select(
        key.alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.unhex(text).alias("frame"))
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    less = spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("k1"), number.alias("k2"),
        F.unhex(F.concat(F.lit("001D"), F.when(F.col("l_returnflag") == "R", "43").otherwise("45"),
                         hex_long(number, 8), hex_long(nanos("l_shipdate"), 8), hex_long(F.col("l_orderkey"), 8),
                         hex_long(F.col("l_quantity"), 4))).alias("frame"))
    return add.unionByName(less)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all conversation turns, whole."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    return docs.unionByName(table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))


def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: events per type and hour as a running count at the hour's last event.

    The running sum goes over hourly rows of a type, far fewer than the events.
    """
    hourly = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
            F.max(nanos("ts")).alias("timestamp_nanos"), F.count("*").alias("n"),
            F.count_if(F.col("value") > 400).alias("bad"))
    w = Window.partitionBy("run").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select("run", "timestamp_nanos", F.sum("n").over(w).alias("received"),
                         F.sum(F.col("n") - F.col("bad")).over(w).alias("emitted"),
                         F.sum("bad").over(w).alias("failed"))


def order_time_text() -> Column:
    return iso_utc(nanos("o_orderdate"))
