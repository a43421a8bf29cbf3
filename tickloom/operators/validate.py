"""Row validation: every rule is a Column, the first failing rule gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.common import keep
from tickloom.functions.ids import event_id
from tickloom.functions.text import trim_symbol, upper_venue
from tickloom.schema import EVENT_TYPES, MAX_QUANTITY, MAX_SCALE

REQUIRED = "REQUIRED_FIELD"
INVALID = "INVALID_FIELD"
VERSION = "SCHEMA_VERSION"
MISMATCH = "EVENT_ID_MISMATCH"
UNSUPPORTED = "UNSUPPORTED_EVENT_TYPE"
NORMALIZATION = "NORMALIZATION_ERROR"

OUT_OF_RANGE = " is outside its allowed range"


def issue(reason: str, detail: Column | str) -> Column:
    if isinstance(detail, str):
        # One parsed literal instead of several calls; rule lists hold hundreds of these.
        quoted = detail.replace("\\", "\\\\").replace("'", "\\'")
        return F.expr(f"named_struct('reason', '{reason}', 'detail', '{quoted}')")
    return F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))


# Each function returns the text of what is wrong with a present value, or NULL.  The texts are fixed
# values: they enter failure messages and through them the stable failure ids.

def source_problem(source: Column) -> Column:
    """1..128 characters of ``[A-Za-z0-9._:/@-]``, the first one a letter or digit."""
    return (F.when(~F.length(source).between(1, 128),
                   "source identity must contain between 1 and 128 characters")
            .when(~source.rlike("^[A-Za-z0-9]"), "source identity must begin with an ASCII letter or digit")
            .when(~source.rlike(r"^[A-Za-z0-9._:/@-]+\z"),
                  "source identity contains an unsupported ASCII character"))


def venue_problem(venue: Column) -> Column:
    """1..32 characters of ``[A-Za-z0-9._-]``; the event keeps it in upper case."""
    return (F.when(~F.length(venue).between(1, 32), "venue must contain between 1 and 32 characters")
            .when(~venue.rlike(r"^[A-Za-z0-9._-]+\z"),
                  "venue must use ASCII letters, digits, hyphen, underscore, or period"))


def symbol_problem(symbol: Column) -> Column:
    """At most eight characters, padding included; printable ASCII with trailing spaces only."""
    return (F.when(F.length(symbol) > 8, "symbol must contain at most 8 bytes")
            .when(~symbol.rlike(r"^[!-~]* *\z"), "symbol must use printable ASCII with trailing spaces only")
            .when(F.rtrim(symbol) == "", "symbol must not be empty"))


def reference_problem(reference: Column) -> Column:
    """1..256 characters of printable ASCII without spaces."""
    return (F.when(~F.length(reference).between(1, 256),
                   "raw event reference must contain between 1 and 256 characters")
            .when(~reference.rlike(r"^[!-~]+\z"),
                  "raw event reference must use printable, non-space ASCII characters"))


def event_id_problem(value: Column) -> Column:
    """64 lowercase hexadecimal characters."""
    return F.when(~value.rlike(r"^[0-9a-f]{64}\z"), "event ID must be 64 lowercase hexadecimal characters")


def required(column: Column, path: str) -> Column:
    return F.when(column.isNull(), issue(REQUIRED, f"{path} is required"))


def required_text(column: Column, path: str) -> Column:
    return F.when(column.isNull() | (column == ""), issue(REQUIRED, f"{path} is required"))


def in_range(column: Column, path: str, low: int, high: int | None = None) -> Column:
    bad = column < low if high is None else ~column.between(low, high)
    return F.when(bad, issue(INVALID, path + OUT_OF_RANGE))


def constructed(problem: Column, path: str) -> Column:
    return F.when(problem.isNotNull(), issue(INVALID, F.concat(F.lit(f"{path}: "), problem)))


def envelope_issues(metadata: Column, instrument: Column) -> list[Column]:
    """Rules of the metadata envelope and the instrument, in their order."""
    m = metadata
    version = m["schemaVersion"]
    major, minor = version["major"], version["minor"]
    source, sequence = m["source"], m["sequenceNumber"]
    return [
        required(m, "metadata"),
        required(version, "metadata.schemaVersion"),
        required(major, "metadata.schemaVersion.major"),
        required(minor, "metadata.schemaVersion.minor"),
        F.when((major != 1) | (minor != 0), issue(VERSION, "metadata.schemaVersion must be 1.0")),
        required_text(m["eventId"], "metadata.eventId"),
        required_text(source, "metadata.source"),
        required_text(m["venue"], "metadata.venue"),
        required(m["exchangeTimestamp"], "metadata.exchangeTimestamp"),
        in_range(m["exchangeTimestamp"], "metadata.exchangeTimestamp", 0),
        in_range(m["receiveTimestamp"], "metadata.receiveTimestamp", 0),
        required(sequence, "metadata.sequenceNumber"),
        in_range(sequence, "metadata.sequenceNumber", 1),
        required_text(m["rawEventReference"], "metadata.rawEventReference"),
        required(instrument, "instrument"),
        required_text(instrument["symbol"], "instrument.symbol"),
        constructed(source_problem(source), "metadata.source"),
        constructed(event_id_problem(m["eventId"]), "metadata.eventId"),
        F.when(m["eventId"] != event_id(source, sequence), issue(
            MISMATCH, "metadata.eventId does not match metadata.source and metadata.sequenceNumber")),
        constructed(venue_problem(m["venue"]), "metadata.venue"),
        constructed(reference_problem(m["rawEventReference"]), "metadata.rawEventReference"),
        constructed(symbol_problem(instrument["symbol"]), "instrument.symbol"),
    ]


def _side(column: Column, path: str) -> Column:
    return F.when(~column.isin("BUY", "SELL"), issue(INVALID, f"{path} must be BUY or SELL"))


def _level(level: Column, path: str) -> list[Column]:
    price, quantity = level["price"], level["quantity"]
    return [F.when(level.isNotNull(), rule) for rule in (
        F.when(price.isNull() | quantity.isNull(), issue(
            REQUIRED, f"{path}.price and {path}.quantity are required")),
        F.when(price["mantissa"].isNull() | price["scale"].isNull(), issue(
            REQUIRED, f"{path}.price.mantissa and {path}.price.scale are required")),
        F.when(~price["scale"].between(0, MAX_SCALE), issue(
            NORMALIZATION, f"scale must be between 0 and {MAX_SCALE}")),
        F.when(~quantity.between(1, MAX_QUANTITY), issue(
            NORMALIZATION, f"quantity must be between 1 and {MAX_QUANTITY}")),
    )]


def payload_issues(payload: Column) -> list[Column]:
    """Rules per event type, in their order."""
    p, kind = payload, payload["type"]

    def number(name: str, low: int, high: int | None = None) -> list[Column]:
        path = f"payload.{name}"
        return [required(p[name], path), in_range(p[name], path, low, high)]

    price = [
        required(p["price"], "payload.price"),
        required(p["price"]["mantissa"], "payload.price.mantissa"),
        required(p["price"]["scale"], "payload.price.scale"),
        in_range(p["price"]["scale"], "payload.price.scale", 0, MAX_SCALE),
    ]
    rules = {
        "ORDER_ADDED": [*number("orderId", 0), required(p["side"], "payload.side"),
                        *number("quantity", 1, MAX_QUANTITY), *price, _side(p["side"], "payload.side")],
        "ORDER_EXECUTED": [*number("orderId", 0), *number("executedQuantity", 1, MAX_QUANTITY)],
        "ORDER_CANCELLED": [*number("orderId", 0), *number("cancelledQuantity", 1, MAX_QUANTITY)],
        "TRADE": [*number("tradeId", 0), *number("quantity", 1, MAX_QUANTITY), *price,
                  _side(p["aggressorSide"], "payload.aggressorSide")],
        "QUOTE": [*_level(p["bid"], "payload.bid"), *_level(p["ask"], "payload.ask"),
                  F.when(p["bid"].isNull() & p["ask"].isNull(), issue(
                      REQUIRED, "payload.bid or payload.ask is required"))],
    }
    chosen = F
    by_type: Column | None = None
    for name in EVENT_TYPES:
        first = F.coalesce(*rules[name])
        by_type = chosen.when(kind == name, first) if by_type is None else by_type.when(kind == name, first)
    return [
        F.when(p.isNull(), issue(INVALID, "payload must be an object")),
        required(kind, "payload.type"),
        F.when(~kind.isin(*EVENT_TYPES), issue(
            UNSUPPORTED, F.concat(F.lit("payload.type is not supported: "), kind))),
        by_type,
    ]


def with_validation(df: DataFrame) -> DataFrame:
    """Add ``_issue`` (reason, detail of the first failing rule, else NULL).

    Works on batch and streaming frames with metadata, instrument and payload columns.
    """
    rules = envelope_issues(F.col("metadata"), F.col("instrument")) + payload_issues(F.col("payload"))
    return df.withColumn("_issue", F.coalesce(*rules))


def normalized(df: DataFrame) -> DataFrame:
    """Venue in upper case and symbol without padding, as a valid event stores them."""
    return df.withColumns({
        "metadata": F.col("metadata").withField("venue", upper_venue(F.col("metadata.venue"))),
        "instrument": F.col("instrument").withField("symbol", trim_symbol(F.col("instrument.symbol"))),
    })


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected rows with ``_issue``)."""
    checked = with_validation(df)
    return (normalized(keep(checked, F.col("_issue").isNull()).drop("_issue")),
            keep(checked, F.col("_issue").isNotNull()))
