"""Output blueprint: a typed description of the output record, rendered as one projection.

``render_blueprint`` adds ``output`` (struct), ``output_json`` (the exact JSON line) and
``_blueprint_failure``.  A row with a failure has neither output nor JSON: no partial documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.functions.fixed import fd_plain, fixed
from tickloom.functions.jsontext import json_array, json_object, json_string, json_value
from tickloom.functions.times import iso_utc
from tickloom.operators.conditions import Condition, build, check_comparison, compare, missing
from tickloom.operators.document import (
    DOCUMENT, Document, canonical_document, current_document, literal,
)
from tickloom.schema import (
    DECIMAL_TYPE, FIXED_DECIMAL, MAX_LONG, MAX_SCALE, MIN_LONG, OBJECT, SPARK_TYPES,
    TIMESTAMP_NANOS, check_path, struct_of,
)

OUTPUT = "output"
OUTPUT_JSON = "output_json"
BLUEPRINT_FAILURE = "_blueprint_failure"

MAX_DEPTH = 16
MAX_FIELDS = 512
MAX_ARRAY_ITEMS = 256
MAX_KEY_LENGTH = 128

# Output formats and the logical type each needs.
FORMATS = {"FIXED_DECIMAL_PLAIN": FIXED_DECIMAL, "TIMESTAMP_ISO_UTC": TIMESTAMP_NANOS}

_DECIMAL_TEXT = re.compile(r"-?[0-9]+\.[0-9]+\Z")


@dataclass
class Node:
    """A rendered node: typed value, JSON text, and whether the node appears at all."""

    value: Column
    json: Column
    shown: Column | None = None  # None: always part of the output


class Decimal:
    """Exact decimal literal of a blueprint: ``Decimal("123.4500")`` keeps scale 4."""

    def __init__(self, text: str):
        if not _DECIMAL_TEXT.match(text):
            raise ValueError("decimal literal must be plain digits with a decimal point")
        fraction = text.partition(".")[2]
        self.mantissa = int(text.replace(".", ""))
        self.scale = len(fraction)
        if self.scale > MAX_SCALE:
            raise ValueError("decimal literal must be an exact fixed decimal with scale 0..18")
        if not MIN_LONG <= self.mantissa <= MAX_LONG:
            raise ValueError("decimal literal is outside the signed 64-bit range")


def load_blueprint(text: str) -> dict:
    """Blueprint from JSON text with decimals kept exactly as written."""
    import json

    def whole(token: str) -> int:
        value = int(token)
        if not MIN_LONG <= value <= MAX_LONG:
            raise ValueError("integer is outside int64 range")
        return value

    return json.loads(text, parse_float=Decimal, parse_int=whole)


class _Renderer:
    def __init__(self, canonical: Document, transformed: Document | None):
        self.canonical = canonical
        self.transformed = transformed
        self.errors: list[Column] = []
        self.count = 0

    def add(self, location: str) -> None:
        self.count += 1
        if self.count > MAX_FIELDS:
            raise ValueError(f"LIMIT_EXCEEDED: blueprint fields exceed {MAX_FIELDS}")

    def resolve(self, spec: dict, location: str) -> tuple[Document, str, str]:
        source, path = spec.get("source"), check_path(spec.get("path"))
        if source == "canonical":
            doc = self.canonical
        elif source == "transformed":
            if self.transformed is None:
                raise ValueError(f"TRANSFORMED_SCHEMA_REQUIRED: {location}")
            doc = self.transformed
        else:
            raise ValueError(f"unknown blueprint source at {location}: {source}")
        if path not in doc.fields:
            raise ValueError(f"UNKNOWN_FIELD: unknown {source} field at {location}: {path}")
        return doc, path, f"referenced {source} field is absent: {path}"

    def fail(self, guard: Column | None, when: Column, error: Column) -> None:
        hit = when if guard is None else guard & when
        self.errors.append(F.when(hit, error))

    def reference(self, spec: dict, location: str, guard: Column | None) -> tuple[Column, str, Document, str]:
        doc, path, detail = self.resolve(spec, location)
        self.fail(guard, doc.absent(path), missing(location, detail))
        return doc.value(path), doc.fields[path].type, doc, path

    def node(self, spec: dict, location: str, depth: int, guard: Column | None) -> Node:
        if depth > MAX_DEPTH:
            raise ValueError(f"LIMIT_EXCEEDED: blueprint depth exceeds {MAX_DEPTH} at {location}")
        kind = spec.get("kind")
        if kind == "reference":
            value, logical, doc, path = self.reference(spec, location, guard)
            dtype = SPARK_TYPES[logical] if logical != OBJECT else \
                _subtree_type(doc, path)
            return Node(value, json_value(value, dtype))
        if kind == "format":
            wanted = FORMATS.get(spec.get("format"))
            if wanted is None:
                raise ValueError(f"unknown format at {location}: {spec.get('format')}")
            value, logical, _, _ = self.reference(spec, location, guard)
            if logical != wanted:
                raise ValueError(f"UNSUPPORTED_FORMAT: {spec['format']} requires {wanted} at {location}")
            text = fd_plain(value) if wanted == FIXED_DECIMAL else iso_utc(value)
            return Node(text, json_string(text))
        if kind == "literal":
            return _literal(spec.get("value"), location)
        if kind == "object":
            return self.object(spec, location, depth, guard)
        if kind == "array":
            return self.array(spec, location, depth, guard)
        if kind == "conditional":
            test = self.condition(spec["condition"], location)
            self.fail(guard, test.error.isNotNull(), test.error)
            inner_guard = test.value if guard is None else guard & test.value
            inner = self.node(spec["value"], location + ".value", depth + 1, inner_guard)
            shown = test.value if inner.shown is None else test.value & inner.shown
            return Node(F.when(test.value, inner.value), F.when(test.value, inner.json), shown)
        raise ValueError(f"unknown blueprint kind at {location}: {kind}")

    def object(self, spec: dict, location: str, depth: int, guard: Column | None) -> Node:
        members: dict[str, Node] = {}
        for key, child in spec["fields"].items():
            if not key.strip() or len(key) > MAX_KEY_LENGTH:
                raise ValueError(f"{location} has a key that is empty or longer than {MAX_KEY_LENGTH}")
            self.add(f"{location}.{key}")
            members[key] = self.node(child, f"{location}.{key}", depth + 1, guard)
        value = F.struct(*[n.value.alias(k) for k, n in members.items()])
        return Node(value, json_object({k: n.json for k, n in members.items()}))

    def array(self, spec: dict, location: str, depth: int, guard: Column | None) -> Node:
        items = spec["items"]
        if len(items) > MAX_ARRAY_ITEMS:
            raise ValueError(f"LIMIT_EXCEEDED: array exceeds {MAX_ARRAY_ITEMS} items at {location}")
        nodes = []
        for index, child in enumerate(items):
            self.add(f"{location}[{index}]")
            nodes.append(self.node(child, f"{location}[{index}]", depth + 1, guard))
        # Items may differ in type, so the typed form is ARRAY<VARIANT>; the JSON text keeps the
        # trailing zeros of decimals, which a variant does not.
        value = F.array_compact(F.array(*[F.try_parse_json(n.json) for n in nodes])) if nodes else \
            F.array().cast(T.ArrayType(T.VariantType()))
        return Node(value, json_array([n.json for n in nodes]))

    def condition(self, spec: dict, location: str) -> Condition:
        def leaf(item: dict) -> Condition:
            doc, path, detail = self.resolve(item, location)
            value = literal(item["value"])
            check_comparison(doc.fields[path].type, item["operator"], value, path)
            return Condition(compare(doc.leaves[path], item["operator"], value),
                             F.when(doc.absent(path), missing(path, detail)))

        return build(spec, leaf)


def _subtree_type(doc: Document, path: str) -> T.StructType:
    return struct_of({p: f for p, f in doc.fields.items()}, path)


def _literal(value: object, location: str) -> Node:
    if isinstance(value, bool):
        return Node(F.lit(value), F.lit("true" if value else "false"))
    if isinstance(value, int):
        if not MIN_LONG <= value <= MAX_LONG:
            raise ValueError(f"integer is outside int64 range at {location}")
        return Node(F.lit(value).cast("bigint"), F.lit(str(value)))
    if isinstance(value, str):
        return Node(F.lit(value), json_string(F.lit(value)))
    if isinstance(value, Decimal):
        column = fixed(value.mantissa, value.scale)
        return Node(column, fd_plain(column))
    raise ValueError(f"literal must be a string, boolean, or exact number at {location}")


def render_blueprint(df: DataFrame, blueprint: dict) -> DataFrame:
    """Render ``blueprint`` for every row; ``transformed`` references need ``document``.

    ``output_json`` keeps keys sorted, leaves omitted fields out and prints decimals plainly.  The
    row's first failure, in the order of the blueprint, is in ``_blueprint_failure``
    (path = output location or compared field, detail).
    """
    if "output" in blueprint:
        if blueprint.get("schemaVersion") != "1.0":
            raise ValueError("blueprint schemaVersion must be 1.0")
        blueprint = blueprint["output"]
    if blueprint.get("kind") != "object":
        raise ValueError("blueprint output must be an object")
    transformed = current_document(df) if DOCUMENT in df.columns else None
    renderer = _Renderer(canonical_document(df), transformed)
    root = renderer.node(blueprint, "$", 0, None)
    error = F.coalesce(*renderer.errors) if renderer.errors else \
        F.lit(None).cast("struct<path:string,detail:string>")
    out = df.withColumn(BLUEPRINT_FAILURE, error)
    fine = F.col(BLUEPRINT_FAILURE).isNull()
    return out.withColumns({OUTPUT: F.when(fine, root.value), OUTPUT_JSON: F.when(fine, root.json)})


# Small builders for rules written in Python.

def reference(path: str, source: str = "canonical") -> dict:
    return {"kind": "reference", "source": source, "path": path}


def formatted(path: str, style: str, source: str = "canonical") -> dict:
    return {"kind": "format", "source": source, "path": path, "format": style}


def constant(value: object) -> dict:
    return {"kind": "literal", "value": value}


def record(**fields: dict) -> dict:
    return {"kind": "object", "fields": fields}


def listed(*items: dict) -> dict:
    return {"kind": "array", "items": list(items)}


def when(condition: dict, value: dict) -> dict:
    return {"kind": "conditional", "condition": condition, "value": value}


def test(path: str, operator: str, value: dict, source: str = "canonical") -> dict:
    return {"type": "comparison", "source": source, "path": path, "operator": operator, "value": value}
