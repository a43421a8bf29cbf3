"""Canonical JSON Lines: one event per line, one typed error per bad line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.common import keep
from tickloom.functions.text import is_blank
from tickloom.operators.validate import (
    INVALID, REQUIRED, UNSUPPORTED, envelope_issues, issue, normalized, payload_issues,
)
from tickloom.schema import EVENT_TYPES
from tickloom.sources.lines import FILE, read_lines, until_first_error, with_ordinal

EMPTY = "EMPTY_LINE"
MALFORMED = "MALFORMED_JSON"
CONTINUE, FAIL_FAST = "CONTINUE", "FAIL_FAST"

# Members of each object of a record.
RECORD_KEYS = ("metadata", "instrument", "payload")
METADATA_KEYS = ("eventId", "schemaVersion", "source", "venue", "exchangeTimestamp",
                 "receiveTimestamp", "sequenceNumber", "rawEventReference")
VERSION_KEYS = ("major", "minor")
INSTRUMENT_KEYS = ("symbol",)
PRICE_KEYS = ("mantissa", "scale")
LEVEL_KEYS = ("price", "quantity")
PAYLOAD_KEYS = {
    "ORDER_ADDED": ("type", "orderId", "side", "quantity", "price"),
    "ORDER_EXECUTED": ("type", "orderId", "executedQuantity"),
    "ORDER_CANCELLED": ("type", "orderId", "cancelledQuantity"),
    "TRADE": ("type", "tradeId", "aggressorSide", "quantity", "price"),
    "QUOTE": ("type", "bid", "ask"),
}
INT_MIN, INT_MAX = -2147483648, 2147483647

_DOC = "__doc"


_LEVEL_LEAVES = ("price", "price.mantissa", "price.scale", "quantity")
PATHS = (
    "", *RECORD_KEYS, *[f"metadata.{k}" for k in METADATA_KEYS],
    *[f"metadata.schemaVersion.{k}" for k in VERSION_KEYS], "instrument.symbol",
    *[f"payload.{k}" for k in ("type", "orderId", "tradeId", "side", "aggressorSide", "quantity",
                               "executedQuantity", "cancelledQuantity", "price", "price.mantissa",
                               "price.scale", "bid", "ask")],
    *[f"payload.{side}.{leaf}" for side in ("bid", "ask") for leaf in _LEVEL_LEAVES],
)


# Paths that hold an object in a good event, and so have members of their own.
OBJECTS = ("", "metadata", "metadata.schemaVersion", "instrument", "payload", "payload.price", "payload.bid",
           "payload.bid.price", "payload.ask", "payload.ask.price")
# Those that nearly every event has; the others are asked for only where they are.
USUAL = OBJECTS[:5]


def _members_of(path: str) -> list[str]:
    start = f"{path}." if path else ""
    return [p for p in PATHS if p and p.startswith(start) and "." not in p[len(start):]]


def _type_of(path: str) -> str:
    """Type that takes an object apart into nodes, and usual objects in it into theirs."""
    parts = [f"{p.rpartition('.')[2]}:{_type_of(p) if p in USUAL else 'variant'}" for p in _members_of(path)]
    return f"struct<{','.join(parts)}>"


class _Json:
    """Typed access to one parsed line.

    The line is parsed once into a VARIANT; every path is looked up once into a node and a kind
    column, so the many rules only read columns.  Nodes come from casts to structs, an absent member being a NULL field: a lookup by
    path leaves by an exception where there is none, which costs more than all else, and most paths are absent.  Of an
    object only its number of members is taken: its node or schema is a copy of all that lies below it.
    """

    def __init__(self, df: DataFrame):
        self.place = {path: i for i, path in enumerate(PATHS)}
        df = df.withColumn("__o0", F.try_variant_get(F.col(_DOC), "$[0]", _type_of("")))
        for i, path in enumerate(OBJECTS):
            if path not in USUAL:
                df = df.withColumn(f"__o{i}", F.try_variant_get(self._member(path), "$", _type_of(path)))
        members, nodes = {}, {}
        for path in OBJECTS:
            # Values of the map are empty structs, so no member is copied or cast.
            if path in USUAL:
                at = f"$[0].{path}" if path else "$[0]"
                there = self._object(path).isNotNull()
                members[self._count(path)] = F.when(there, self._size(F.col(_DOC), at))
                parent = self._object(path.rpartition(".")[0]).isNotNull() if path else F.lit(True)
                nodes[f"__n{self.place[path]}"] = F.when(~there & parent, F.try_variant_get(F.col(_DOC), at, "variant"))
            else:
                members[self._count(path)] = self._size(self._member(path), "$")
        for path, i in self.place.items():
            if path not in USUAL:
                nodes[f"__n{i}"] = self._member(path)
        # One lambda for all kinds keeps the generated code of this wide stage small.  Objects need none.
        kinds = F.transform(
            F.array(*[F.when(F.col(self._count(p)).isNull(), F.col(f"__n{i}")) if p in OBJECTS else F.col(f"__n{i}")
                      for p, i in self.place.items()]),
            lambda node: F.when(node.isNotNull(), F.substring_index(F.schema_of_variant(node), "<", 1)))
        self.df = df.withColumns({**members, **nodes}).withColumn("__kinds", kinds)

    @staticmethod
    def _size(node: Column, at: str) -> Column:
        return F.size(F.map_keys(F.try_variant_get(node, at, "map<string,struct<>>")))

    @staticmethod
    def _count(path: str) -> str:
        return f"__m{OBJECTS.index(path)}"

    def _object(self, path: str) -> Column:
        """The struct of an object's members; NULL for what is no object."""
        if path in USUAL and path:
            return self._member(path)
        return F.col(f"__o{OBJECTS.index(path)}")

    def _member(self, path: str) -> Column:
        above, _, name = path.rpartition(".")
        return self._object(above)[name]

    @property
    def temporaries(self) -> list[str]:
        return [f"__n{i}" for i in self.place.values()] + [self._count(p) for p in OBJECTS] \
            + [f"__o{i}" for i, p in enumerate(OBJECTS) if not p or p not in USUAL] + ["__kinds"]

    def node(self, path: str) -> Column:
        """Node of a value that is no object; NULL when absent; a JSON null is a variant null."""
        return F.col(f"__n{self.place[path]}")

    def kind(self, path: str) -> Column:
        """JSON kind of the node: OBJECT, ARRAY, STRING, BIGINT, VOID (null), ..; NULL when absent."""
        kind = F.col("__kinds")[self.place[path]]
        return F.when(F.col(self._count(path)).isNotNull(), F.lit("OBJECT")).otherwise(kind) if path in OBJECTS else kind

    def is_object(self, path: str) -> Column:
        return F.col(self._count(path)).isNotNull()

    def has(self, path: str) -> Column:
        return self.kind(path).isNotNull()

    def filled(self, path: str) -> Column:
        """Present and not null."""
        return F.coalesce(self.kind(path) != "VOID", F.lit(False))

    def integer(self, path: str) -> Column:
        """Exact long; NULL for text, fractions, exponents and numbers out of range."""
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.node(path), "$", "bigint"))

    def is_integer(self, path: str) -> Column:
        return self.kind(path).eqNullSafe("BIGINT")

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.node(path), "$", "string")

    def is_text(self, path: str) -> Column:
        return self.kind(path).eqNullSafe("STRING")

    def unknown_keys(self, path: str, allowed: tuple[str, ...]) -> Column:
        """An object with more members than it has allowed ones; each of ``allowed`` is one of the paths."""
        known = [F.when(self.has(f"{path}.{k}" if path else k), 1).otherwise(0) for k in allowed]
        return F.coalesce(F.col(self._count(path)) > reduce(lambda a, b: a + b, known), F.lit(False))


def _price(j: _Json, path: str) -> Column:
    return F.when(j.is_object(path), F.struct(
        j.integer(f"{path}.mantissa").alias("mantissa"),
        j.integer(f"{path}.scale").cast("int").alias("scale")))


def _level(j: _Json, path: str) -> Column:
    return F.when(j.is_object(path), F.struct(
        _price(j, f"{path}.price").alias("price"), j.integer(f"{path}.quantity").alias("quantity")))


def _event_columns(j: _Json) -> dict[str, Column]:
    m = "metadata"
    version = F.when(j.is_object("metadata.schemaVersion"), F.struct(
        j.integer(f"{m}.schemaVersion.major").alias("major"),
        j.integer(f"{m}.schemaVersion.minor").alias("minor")))
    metadata = F.when(j.is_object(m), F.struct(
        j.text(f"{m}.eventId").alias("eventId"), version.alias("schemaVersion"),
        j.text(f"{m}.source").alias("source"), j.text(f"{m}.venue").alias("venue"),
        j.integer(f"{m}.exchangeTimestamp").alias("exchangeTimestamp"),
        j.integer(f"{m}.receiveTimestamp").alias("receiveTimestamp"),
        j.integer(f"{m}.sequenceNumber").alias("sequenceNumber"),
        j.text(f"{m}.rawEventReference").alias("rawEventReference")))
    instrument = F.when(j.is_object("instrument"),
                        F.struct(j.text("instrument.symbol").alias("symbol")))
    p = "payload"
    payload = F.when(j.is_object(p), F.struct(
        j.text(f"{p}.type").alias("type"), j.integer(f"{p}.orderId").alias("orderId"),
        j.integer(f"{p}.tradeId").alias("tradeId"), j.text(f"{p}.side").alias("side"),
        j.text(f"{p}.aggressorSide").alias("aggressorSide"),
        j.integer(f"{p}.quantity").alias("quantity"),
        j.integer(f"{p}.executedQuantity").alias("executedQuantity"),
        j.integer(f"{p}.cancelledQuantity").alias("cancelledQuantity"),
        _price(j, f"{p}.price").alias("price"),
        _level(j, f"{p}.bid").alias("bid"), _level(j, f"{p}.ask").alias("ask")))
    return {"metadata": metadata, "instrument": instrument, "payload": payload}


def _not_object(j: _Json, path: str) -> Column:
    return j.filled(path) & ~j.is_object(path)


def _binding(j: _Json) -> Column:
    """The envelope does not bind: unknown members or values of the wrong JSON type."""
    bad = (j.unknown_keys("", RECORD_KEYS) | _not_object(j, "metadata")
           | j.unknown_keys("metadata", METADATA_KEYS)
           | _not_object(j, "metadata.schemaVersion")
           | j.unknown_keys("metadata.schemaVersion", VERSION_KEYS)
           | _not_object(j, "instrument") | j.unknown_keys("instrument", INSTRUMENT_KEYS))
    for path in ("metadata.eventId", "metadata.source", "metadata.venue",
                 "metadata.rawEventReference", "instrument.symbol"):
        bad = bad | F.coalesce(j.kind(path).isin("OBJECT", "ARRAY"), F.lit(False))
    for path in ("metadata.exchangeTimestamp", "metadata.receiveTimestamp",
                 "metadata.sequenceNumber"):
        bad = bad | (j.filled(path) & ~j.is_integer(path))
    for path in ("metadata.schemaVersion.major", "metadata.schemaVersion.minor"):
        bad = bad | (j.filled(path)
                     & ~F.coalesce(j.integer(path).between(INT_MIN, INT_MAX), F.lit(False)))
    return F.when(bad, issue(MALFORMED, "record does not match the canonical envelope"))


def _number(j: _Json, name: str) -> list[Column]:
    path = f"payload.{name}"
    return [F.when(~j.filled(path), issue(REQUIRED, f"{path} is required")),
            F.when(~j.is_integer(path), issue(
                INVALID, f"{path} must be an exact integer in the Java long range"))]


def _price_shape(j: _Json) -> list[Column]:
    return [F.when(~j.filled("payload.price"), issue(REQUIRED, "payload.price is required")),
            F.when(~j.is_object("payload.price"), issue(INVALID, "payload.price must be an object")),
            *_number(j, "price.mantissa"), *_number(j, "price.scale")]


def _text_shape(j: _Json, name: str) -> list[Column]:
    path = f"payload.{name}"
    return [F.when(~j.filled(path), issue(REQUIRED, f"{path} is required")),
            F.when(~j.is_text(path), issue(INVALID, f"{path} must be a string"))]


def _members(j: _Json, name: str) -> list[Column]:
    detail = "payload has members its type does not know"
    rules = [F.when(j.unknown_keys("payload", PAYLOAD_KEYS[name]), issue(INVALID, detail))]
    if "price" in PAYLOAD_KEYS[name]:
        rules.append(F.when(j.unknown_keys("payload.price", PRICE_KEYS), issue(INVALID, detail)))
    return rules


def _quote_shape(j: _Json) -> list[Column]:
    bad = j.unknown_keys("payload", PAYLOAD_KEYS["QUOTE"])
    absent = []
    for side in ("payload.bid", "payload.ask"):
        bad = (bad | _not_object(j, side) | j.unknown_keys(side, LEVEL_KEYS)
               | _not_object(j, f"{side}.price") | j.unknown_keys(f"{side}.price", PRICE_KEYS))
        for leaf in (f"{side}.price.mantissa", f"{side}.quantity"):
            bad = bad | (j.filled(leaf) & ~j.is_integer(leaf))
        scale = f"{side}.price.scale"
        bad = bad | (j.filled(scale)
                     & ~F.coalesce(j.integer(scale).between(INT_MIN, INT_MAX), F.lit(False)))
        absent.append(F.when(j.has(side) & ~j.filled(side), issue(REQUIRED, f"{side} is required")))
    return [F.when(bad, issue(INVALID, "payload has members its type does not know")), *absent]


def _shape_by_type(j: _Json) -> Column:
    """What the typed values cannot tell any more: JSON types, nulls and unknown members."""
    optional_side = F.when(j.has("payload.aggressorSide"),
                           F.coalesce(*_text_shape(j, "aggressorSide")))
    rules = {
        "ORDER_ADDED": [*_number(j, "orderId"), *_text_shape(j, "side"), *_number(j, "quantity"),
                        *_price_shape(j)],
        "ORDER_EXECUTED": [*_number(j, "orderId"), *_number(j, "executedQuantity")],
        "ORDER_CANCELLED": [*_number(j, "orderId"), *_number(j, "cancelledQuantity")],
        "TRADE": [*_number(j, "tradeId"), optional_side, *_number(j, "quantity"), *_price_shape(j)],
        "QUOTE": _quote_shape(j),
    }
    out: Column | None = None
    for name in EVENT_TYPES:
        first = F.coalesce(*rules[name])
        hit = F.col("payload.type") == name
        out = F.when(hit, first) if out is None else out.when(hit, first)
    return out


def _unknown_by_type(j: _Json) -> Column:
    out: Column | None = None
    for name in EVENT_TYPES[:4]:
        first = F.coalesce(*_members(j, name))
        hit = F.col("payload.type") == name
        out = F.when(hit, first) if out is None else out.when(hit, first)
    return out


def parse_event_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Add metadata, instrument, payload and ``_issue`` (reason, detail) to a frame of JSON lines.

    Works on batch and streaming frames.  Integers must be written as integers: ``1.0`` and ``"1"``
    are rejected everywhere, also in the envelope.
    """
    line = F.col(column)
    # The line as the only item of an array: text after the record breaks the array or adds an item.
    # Events hold no arrays, so a closing bracket is rare and pays for a second check.
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    base = df.withColumn(_DOC, F.when(~is_blank(line), wrapped))
    j = _Json(base)
    second = F.size(F.try_variant_get(F.col(_DOC), "$", "array<struct<>>")) > 1
    stray = line.contains("]") & F.try_parse_json(
        F.concat(F.lit('{"r":'), line, F.lit("}"))).isNull()
    base = j.df.withColumns(_event_columns(j))
    envelope = envelope_issues(F.col("metadata"), F.col("instrument"))
    receive = F.when(j.has("metadata.receiveTimestamp") & ~j.filled("metadata.receiveTimestamp"),
                     issue(REQUIRED, "metadata.receiveTimestamp is required"))
    payload_rules = payload_issues(F.col("payload"))
    kind_text = F.when(j.filled("payload.type") & ~j.is_text("payload.type"),
                       issue(INVALID, "payload.type must be a string"))
    rules = [
        F.when(is_blank(line), issue(EMPTY, "line is empty")),
        F.when(F.col(_DOC).isNull() | second | stray | ~j.has(""),
               issue(MALFORMED, "line is not one JSON value")),
        F.when(~j.is_object(""), issue(INVALID, "record must be an object")),
        _binding(j),
        *envelope[:10], receive, *envelope[10:],
        payload_rules[0], payload_rules[1], kind_text, payload_rules[2],
        _shape_by_type(j), _range_by_type(F.col("payload")), _unknown_by_type(j), payload_rules[3],
    ]
    return base.withColumn("_issue", F.coalesce(*rules)).drop(_DOC, *j.temporaries)


def _range_by_type(payload: Column) -> Column:
    """Ranges come before unknown members, the side value after them."""
    from tickloom.operators.validate import in_range
    from tickloom.schema import MAX_QUANTITY, MAX_SCALE

    def rng(name: str, low: int, high: int | None = None) -> Column:
        column = payload
        for part in name.split("."):
            column = column[part]
        return in_range(column, f"payload.{name}", low, high)

    scale = rng("price.scale", 0, MAX_SCALE)
    quantity = rng("quantity", 1, MAX_QUANTITY)
    kind = payload["type"]
    return (F.when(kind == "ORDER_ADDED", F.coalesce(rng("orderId", 0), quantity, scale))
            .when(kind == "ORDER_EXECUTED",
                  F.coalesce(rng("orderId", 0), rng("executedQuantity", 1, MAX_QUANTITY)))
            .when(kind == "ORDER_CANCELLED",
                  F.coalesce(rng("orderId", 0), rng("cancelledQuantity", 1, MAX_QUANTITY)))
            .when(kind == "TRADE", F.coalesce(rng("tradeId", 0), quantity, scale)))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of a parsed frame; an error keeps place, reason, detail and source text."""
    events = normalized(keep(parsed, F.col("_issue").isNull())).drop("_issue")
    errors = keep(parsed, F.col("_issue").isNotNull()).select(
        *[c for c in parsed.columns if c not in ("metadata", "instrument", "payload", "_issue")],
        F.col("_issue.reason").alias("reason"), F.col("_issue.detail").alias("detail"))
    return events, errors


def read_jsonl_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of JSON Lines files with its event or ``_issue``, from one scan and without a shuffle.

    Lines keep their file, block and scan position; ``lines.with_ordinal`` on these three columns, read
    back from what was written, gives line numbers.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return parse_event_lines(read_lines(spark, path).withColumnRenamed("value", "source_text"), "source_text")


def read_canonical_jsonl(spark: SparkSession, path: str | list[str],
                         mode: str = CONTINUE) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of canonical JSON Lines files.

    Both carry ``file_path``, ``line_number``, ``source_location`` and ``source_text``.  ``FAIL_FAST``
    keeps each file up to and including its first error.
    """
    if mode not in (CONTINUE, FAIL_FAST):
        raise ValueError(f"unknown mode: {mode}")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = with_ordinal(read_lines(spark, path)).withColumnRenamed("value", "source_text")
    lines = lines.select(
        FILE, "line_number", "source_text",
        F.concat(F.col(FILE), F.lit(":line "), F.col("line_number").cast("string"))
        .alias("source_location"))
    parsed = parse_event_lines(lines, "source_text")
    if mode == FAIL_FAST:
        parsed = until_first_error(parsed, keep(parsed, F.col("_issue").isNotNull()))
    return split_parsed(parsed)
