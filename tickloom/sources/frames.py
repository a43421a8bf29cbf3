"""Binary tick frames: one frame per row to typed columns, by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.common import keep
from tickloom.functions.fixed import fixed
from tickloom.functions.ids import event_id, frame_reference
from tickloom.functions.text import trim_symbol, upper_venue
from tickloom.operators.orders import ADD, CANCEL, EXECUTE, NOT_RESOLVED, TRADE, resolve_instruments
from tickloom.operators.validate import issue, symbol_problem
from tickloom.schema import EVENT_SCHEMA, MAX_QUANTITY, MAX_SCALE

# Wire layout, big-endian.  Type byte, encoded length and event kind.
MESSAGE_TYPES = {"A": (47, ADD), "E": (29, EXECUTE), "C": (29, CANCEL), "T": (47, TRADE)}
NAMES = {"A": "ADD_ORDER", "E": "EXECUTE_ORDER", "C": "CANCEL_ORDER", "T": "TRADE"}
UNSUPPORTED = "UNSUPPORTED"

TRUNCATED = "TRUNCATED_FRAME"
BAD_LENGTH = "INVALID_FRAME_LENGTH"
TRAILING = "TRAILING_FRAME_BYTES"
TOO_LARGE = "FRAME_TOO_LARGE"
BAD_FIELD = "INVALID_FIELD_ENCODING"
UNSUPPORTED_TYPE = "UNSUPPORTED_MESSAGE_TYPE"

_HEX = "__hex"


def _number(first_byte: int, width: int) -> Column:
    """Signed value of ``width`` bytes from a 0-based byte offset of the hex text."""
    digits = F.substring(F.col(_HEX), first_byte * 2 + 1, width * 2)
    return F.conv(digits, 16, -10).cast("bigint")


def _field(name: str, problem: Column | str) -> Column:
    text = problem if isinstance(problem, Column) else F.lit(problem)
    return F.struct(F.lit(BAD_FIELD).alias("reason"),
                    F.concat(F.lit(f"invalid STP {name}: "), text).alias("detail"))


def decode_columns(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add message_type, kind, sequence, event_time, order_id, trade_id, symbol, side, quantity,
    price and ``_issue`` to a frame with one binary frame per row.

    An unknown type byte is no decode error: the row keeps ``kind`` UNSUPPORTED.  Works on streams.
    """
    data = F.col(frame)
    size = F.octet_length(data)
    df = df.withColumn(_HEX, F.hex(data))
    length = _number(0, 2)
    code = F.conv(F.substring(F.col(_HEX), 5, 2), 16, 10).cast("int")
    letter = F.when(code.isin([ord(c) for c in MESSAGE_TYPES]), F.chr(code.cast("bigint")))
    staged = df.withColumns({
        "__size": size, "__length": F.when(size >= 2, length),
        "__code": F.when(size >= 3, code), "__type": F.when(size >= 3, letter)})
    kind, wanted = F.col("__type"), None
    for c, (encoded, _) in MESSAGE_TYPES.items():
        wanted = F.when(kind == c, encoded) if wanted is None else wanted.when(kind == c, encoded)
    framed = (F.col("__size") == F.col("__length") + 2) & (F.col("__length") == wanted)
    long_form, short_form = kind.isin("A", "T"), kind.isin("E", "C")
    side = F.decode(F.substring(data, F.lit(36), F.lit(1)), "ISO-8859-1")
    columns = {
        "sequence": F.when(framed, _number(3, 8)),
        "event_time": F.when(framed, _number(11, 8)),
        "__id": F.when(framed, _number(19, 8)),
        "__symbol": F.when(framed & long_form, F.decode(F.substring(data, F.lit(28), F.lit(8)), "ISO-8859-1")),
        "__side": F.when(framed & long_form, side),
        "quantity": F.when(framed & long_form, _number(36, 4)).when(framed & short_form, _number(27, 4)),
        "__mantissa": F.when(framed & long_form, _number(40, 8)),
        "__scale": F.when(framed & long_form, _number(48, 1)),
    }
    staged = staged.withColumns(columns)
    c = F.col
    id_name = F.when(kind == "T", "trade ID").otherwise("order ID")
    quantity_name = F.when(kind == "E", "executed quantity").when(kind == "C", "canceled quantity") \
        .otherwise("quantity")
    side_name = F.when(kind == "T", "aggressor side").otherwise("side")

    def named(name: Column, text: str) -> Column:
        return F.struct(F.lit(BAD_FIELD).alias("reason"),
                        F.concat(F.lit("invalid STP "), name, F.lit(f": {text}")).alias("detail"))

    def declared(wants: Column, has: Column) -> Column:
        return F.concat(F.lit("STP frame requires "), wants.cast("string"), F.lit(" bytes but only "),
                        has.cast("string"), F.lit(" are available"))

    issues = [
        F.when(c("__size") < 2, issue(TRUNCATED, declared(F.lit(2), c("__size")))),
        F.when(c("__length") < 1, issue(BAD_LENGTH, F.concat(
            F.lit("encoded length must be between 1 and 65535: "), c("__length").cast("string")))),
        F.when(c("__size") < c("__length") + 2, issue(TRUNCATED, declared(c("__length") + 2, c("__size")))),
        F.when(c("__size") > c("__length") + 2, issue(TRAILING, F.concat(
            F.lit("STP frame declares "), (c("__length") + 2).cast("string"),
            F.lit(" bytes but input contains "), c("__size").cast("string")))),
        F.when(kind.isNotNull() & (c("__length") != wanted), issue(BAD_LENGTH, F.concat(
            F.lit("encoded length for "), lookup_name(kind), F.lit(" must be "), wanted.cast("string"),
            F.lit(": "), c("__length").cast("string")))),
        F.when(c("sequence") < 1, _field("sequence number", "sequence number must be positive")),
        F.when(c("event_time") < 0, _field("event timestamp", "nanosecondsSinceEpoch must not be negative")),
        F.when(c("__id") < 0, F.when(kind == "T", named(id_name, "trade ID must not be negative"))
               .otherwise(named(id_name, "order ID must not be negative"))),
        F.when(symbol_problem(c("__symbol")).isNotNull(), _field("symbol", symbol_problem(c("__symbol")))),
        F.when(~c("__side").isin("B", "S"), named(side_name, "side must be B or S")),
        F.when(~c("quantity").between(1, MAX_QUANTITY),
               named(quantity_name, f"quantity must be between 1 and {MAX_QUANTITY}")),
        F.when(~c("__scale").between(0, MAX_SCALE), _field("price", f"scale must be between 0 and {MAX_SCALE}")),
    ]
    kinds = None
    for letter_, (_, name) in MESSAGE_TYPES.items():
        kinds = F.when(kind == letter_, name) if kinds is None else kinds.when(kind == letter_, name)
    return staged.withColumns({
        "message_type": c("__code"),
        "kind": F.coalesce(kinds, F.when(c("__code").isNotNull(), F.lit(UNSUPPORTED))),
        "order_id": F.when(kind != "T", c("__id")), "trade_id": F.when(kind == "T", c("__id")),
        "symbol": trim_symbol(c("__symbol")),
        "side": F.when(c("__side") == "B", "BUY").when(c("__side") == "S", "SELL"),
        "price": F.when(c("__mantissa").isNotNull(), fixed(c("__mantissa"), c("__scale"))),
        "_issue": F.coalesce(*issues),
    }).drop(_HEX, "__size", "__length", "__code", "__type", "__id", "__symbol", "__side", "__mantissa", "__scale")


def lookup_name(kind: Column) -> Column:
    out = None
    for letter, name in NAMES.items():
        out = F.when(kind == letter, name) if out is None else out.when(kind == letter, name)
    return out


def decode_frames(df: DataFrame, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(decoded frames, errors): a frame with a bad length or field becomes a typed error row."""
    decoded = decode_columns(df, frame)
    errors = keep(decoded, F.col("_issue").isNotNull()).select(
        *df.columns, F.col("_issue.reason").alias("reason"), F.col("_issue.detail").alias("detail"))
    return keep(decoded, F.col("_issue").isNull()).drop("_issue"), errors


def normalize_frames(decoded: DataFrame, venue: str, source: str = "source",
                     stream: str | None = None, order: str | list[str] = "frame_number",
                     parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, failures) of decoded frames: instruments resolved, then canonical columns built.

    ``stream`` names the column whose rows share order state, the source by default.  A frame of an
    unknown type fails with UNSUPPORTED_MESSAGE_TYPE, an Execute or Cancel without an
    open order with INSTRUMENT_NOT_RESOLVED.
    """
    order = [order] if isinstance(order, str) else list(order)
    resolved = resolve_instruments(decoded, source=stream or source, order=order, parts=parts)
    reason = F.when(F.col("kind") == UNSUPPORTED, F.lit(UNSUPPORTED_TYPE)).otherwise(F.col("resolve_error"))
    detail = F.when(F.col("kind") == UNSUPPORTED, F.concat(
        F.lit("STP message type "), F.col("message_type").cast("string"),
        F.lit(" is not assigned by STP v1"))).otherwise(F.concat(
            F.lit("no instrument is known for STP order "), F.col("order_id").cast("string")))
    resolved = resolved.withColumns({"reason": reason, "detail": F.when(reason.isNotNull(), detail)})
    failures = resolved.filter(F.col("reason").isNotNull()).drop("instrument", "resolve_error")
    good = resolved.filter(F.col("reason").isNull()).drop("reason", "detail", "resolve_error")
    kind = F.col("kind")
    types = {f.name: f.dataType for f in EVENT_SCHEMA["payload"].dataType.fields}
    given = {
        "type": kind, "orderId": F.col("order_id"), "tradeId": F.col("trade_id"),
        "side": F.when(kind == ADD, F.col("side")), "aggressorSide": F.when(kind == TRADE, F.col("side")),
        "quantity": F.when(kind.isin(ADD, TRADE), F.col("quantity")),
        "executedQuantity": F.when(kind == EXECUTE, F.col("quantity")),
        "cancelledQuantity": F.when(kind == CANCEL, F.col("quantity")),
        "price": F.when(kind.isin(ADD, TRADE), F.col("price")),
    }
    events = good.select(
        *[c for c in decoded.columns if c not in (
            "kind", "message_type", "sequence", "event_time", "order_id", "trade_id", "symbol", "side",
            "quantity", "price")],
        F.struct(
            event_id(F.col(source), F.col("sequence")).alias("eventId"),
            F.struct(F.lit(1).cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor"))
            .alias("schemaVersion"),
            F.col(source).alias("source"), upper_venue(F.lit(venue)).alias("venue"),
            F.col("event_time").alias("exchangeTimestamp"),
            F.lit(None).cast("bigint").alias("receiveTimestamp"),
            F.col("sequence").alias("sequenceNumber"),
            frame_reference(F.col(source), F.col(order[0])).alias("rawEventReference")).alias("metadata"),
        F.struct(F.col("instrument").alias("symbol")).alias("instrument"),
        F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]).alias("payload"))
    return events, failures


__all__ = ["decode_columns", "decode_frames", "normalize_frames", "NOT_RESOLVED", "UNSUPPORTED"]
