"""Canonical event model: struct types, field catalog, protected paths and path rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

STRING = "STRING"
BOOLEAN = "BOOLEAN"
INT64 = "INT64"
FIXED_DECIMAL = "FIXED_DECIMAL"
ENUM = "ENUM"
TIMESTAMP_NANOS = "TIMESTAMP_NANOS"
OBJECT = "OBJECT"

MAX_LONG = 9223372036854775807
MIN_LONG = -9223372036854775808
MAX_SCALE = 18
MAX_QUANTITY = 4294967295

# A fixed decimal keeps its own scale in every row: 1.00 and 1 are equal but print differently, so
# one DecimalType could not hold the column without losing the scale.
DECIMAL_TYPE = T.StructType([
    T.StructField("mantissa", T.LongType()),
    T.StructField("scale", T.IntegerType()),
])

SPARK_TYPES = {
    STRING: T.StringType(),
    BOOLEAN: T.BooleanType(),
    INT64: T.LongType(),
    FIXED_DECIMAL: DECIMAL_TYPE,
    ENUM: T.StringType(),
    TIMESTAMP_NANOS: T.LongType(),
}


@dataclass(frozen=True)
class Field:
    """One catalog entry: the logical type of a path and whether rules may change it."""

    type: str
    protected: bool = False


# The canonical field catalog (path, logical type, protected).
CANONICAL_FIELDS: dict[str, Field] = {
    "metadata": Field(OBJECT, True),
    "metadata.eventId": Field(STRING, True),
    "metadata.schemaVersion": Field(OBJECT, True),
    "metadata.schemaVersion.major": Field(INT64, True),
    "metadata.schemaVersion.minor": Field(INT64, True),
    "metadata.source": Field(STRING, True),
    "metadata.venue": Field(STRING, True),
    "metadata.exchangeTimestamp": Field(TIMESTAMP_NANOS, True),
    "metadata.receiveTimestamp": Field(TIMESTAMP_NANOS, True),
    "metadata.sequenceNumber": Field(INT64, True),
    "metadata.rawEventReference": Field(STRING, True),
    "instrument": Field(OBJECT),
    "instrument.symbol": Field(STRING),
    "payload": Field(OBJECT),
    "payload.type": Field(ENUM, True),
    "payload.orderId": Field(INT64),
    "payload.tradeId": Field(INT64),
    "payload.side": Field(ENUM),
    "payload.aggressorSide": Field(ENUM),
    "payload.quantity": Field(INT64),
    "payload.executedQuantity": Field(INT64),
    "payload.cancelledQuantity": Field(INT64),
    "payload.price": Field(FIXED_DECIMAL),
    "payload.bid": Field(OBJECT),
    "payload.bid.price": Field(FIXED_DECIMAL),
    "payload.bid.quantity": Field(INT64),
    "payload.ask": Field(OBJECT),
    "payload.ask.price": Field(FIXED_DECIMAL),
    "payload.ask.quantity": Field(INT64),
}

PROTECTED = frozenset(path for path, field in CANONICAL_FIELDS.items() if field.protected)

EVENT_TYPES = ("ORDER_ADDED", "ORDER_EXECUTED", "ORDER_CANCELLED", "TRADE", "QUOTE")


def struct_of(fields: dict[str, Field], prefix: str = "") -> T.StructType:
    """Spark struct for the catalog entries directly and indirectly below ``prefix``."""
    out = []
    for path, field in fields.items():
        parent, _, leaf = path.rpartition(".")
        if parent != prefix:
            continue
        dtype = struct_of(fields, path) if field.type == OBJECT else SPARK_TYPES[field.type]
        out.append(T.StructField(leaf, dtype))
    return T.StructType(out)


# metadata, instrument and payload as one wide nullable row; NULL means absent, which loses nothing
# because an explicit null is never a legal value.
EVENT_SCHEMA = struct_of(CANONICAL_FIELDS)

FAILURE_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("operationIndex", T.IntegerType()),
    T.StructField("operationName", T.StringType()),
    T.StructField("fieldPath", T.StringType()),
    T.StructField("detail", T.StringType()),
])

DEAD_LETTER_SCHEMA = T.StructType([
    T.StructField("failureId", T.StringType()),
    T.StructField("pipelineId", T.StringType()),
    T.StructField("pipelineVersion", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("sourceLocation", T.StringType()),
    T.StructField("eventId", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("safeMessage", T.StringType()),
    T.StructField("payload", T.StructType([
        T.StructField("encoding", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("value", T.StringType()),
    ])),
    T.StructField("timestamp", T.StringType()),
    T.StructField("retryability", T.StringType()),
    T.StructField("canonicalSchemaVersion", T.StringType()),
    T.StructField("pipelineSchemaVersion", T.StringType()),
])

_PATH = re.compile(r"[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)*")
MAX_PATH_LENGTH = 256
MAX_PATH_SEGMENTS = 16

# Segments a rule may not name.
FORBIDDEN_SEGMENTS = frozenset({
    "class", "classLoader", "getClass", "metaClass", "prototype", "constructor", "__proto__",
})


def check_path(path: str) -> str:
    """Return ``path`` when it is a legal dotted field path, else raise ``ValueError``."""
    names = path.split(".") if isinstance(path, str) and _PATH.fullmatch(path) else []
    if not 1 <= len(names) <= MAX_PATH_SEGMENTS or len(path) > MAX_PATH_LENGTH:
        raise ValueError(f"{path!r} is no field path: names joined by dots, at most {MAX_PATH_SEGMENTS} of them "
                         f"and {MAX_PATH_LENGTH} characters")
    if reserved := FORBIDDEN_SEGMENTS.intersection(names):
        raise ValueError(f"{path!r} names {', '.join(sorted(reserved))}, which rules may not touch")
    return path


def parent_of(path: str) -> str:
    return path.rpartition(".")[0]


def is_under(path: str, ancestor: str) -> bool:
    """True when ``path`` is ``ancestor`` or lies below it."""
    return path == ancestor or path.startswith(ancestor + ".")


def logical_type(dtype: T.DataType) -> str:
    """Logical type of a Spark type; text reads as STRING and a long as INT64."""
    if isinstance(dtype, T.StructType):
        names = [f.name for f in dtype.fields]
        return FIXED_DECIMAL if names == ["mantissa", "scale"] else OBJECT
    if isinstance(dtype, T.StringType):
        return STRING
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT64
    raise ValueError(f"type {dtype.simpleString()} has no place in an event document")
