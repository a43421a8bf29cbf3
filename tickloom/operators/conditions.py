"""Conditions as a pair of Columns: the truth value and the first missing field.

A missing field fails the row instead of making the condition NULL, and ``all`` / ``any`` stop at the
first decided child, so a missing field behind a decided branch is no failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tickloom.functions.fixed import fd_compare_literal
from tickloom.operators.document import Document, Literal, literal
from tickloom.schema import FIXED_DECIMAL, INT64, OBJECT, STRING, TIMESTAMP_NANOS, check_path

OPERATORS = ("EQ", "NE", "LT", "LTE", "GT", "GTE")
ORDERED = (STRING, INT64, FIXED_DECIMAL, TIMESTAMP_NANOS)
MAX_DEPTH = 16
MAX_NODES = 256


@dataclass(frozen=True)
class Condition:
    """``value`` is meaningful where ``error`` (path, detail) is NULL."""

    value: Column
    error: Column


def compare(column: Column, op: str, value: Literal) -> Column:
    """Typed comparison of a present value with a literal.

    Text orders by UTF-8 bytes; that differs from UTF-16 order only between supplementary
    characters and U+E000..U+FFFF.
    """
    if value.type == FIXED_DECIMAL:
        return fd_compare_literal(column, value.mantissa, value.scale, op)
    other = value.column()
    return {"EQ": column == other, "NE": column != other, "LT": column < other,
            "LTE": column <= other, "GT": column > other, "GTE": column >= other}[op]


def check_comparison(kind: str, op: str, value: Literal, path: str) -> None:
    """Reject a comparison of different types, of objects, or an order the type has not."""
    if op not in OPERATORS:
        raise ValueError(f"unknown comparison operator: {op}")
    if kind == OBJECT:
        raise ValueError(f"objects cannot be compared: {path}")
    if kind != value.type:
        raise ValueError(f"comparison value type {value.type} does not match {kind}")
    if op not in ("EQ", "NE") and kind not in ORDERED:
        raise ValueError(f"{op} is not supported for {kind}")


def missing(path: Column | str, detail: Column | str) -> Column:
    path = path if isinstance(path, Column) else F.lit(path)
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(path.alias("path"), detail.alias("detail"))


def fold(kind: str, children: list[Condition]) -> Condition:
    """``all`` or ``any`` over children, left to right with short circuit."""
    out = children[-1]
    for child in reversed(children[:-1]):
        decided = ~child.value if kind == "all" else child.value
        error = (F.when(child.error.isNotNull(), child.error)
                 .when(decided, F.lit(None)).otherwise(out.error))
        value = child.value & out.value if kind == "all" else child.value | out.value
        out = Condition(value, error)
    return out


def build(spec: dict, leaf: Callable[[dict], Condition], depth: int = 1,
          nodes: list[int] | None = None) -> Condition:
    """Condition Columns from the rule's dict; ``leaf`` turns a comparison into a pair."""
    nodes = [0] if nodes is None else nodes
    nodes[0] += 1
    if depth > MAX_DEPTH:
        raise ValueError(f"condition nesting exceeds {MAX_DEPTH}")
    if nodes[0] > MAX_NODES:
        raise ValueError(f"condition exceeds {MAX_NODES} nodes")
    kind = spec.get("type")
    if kind == "comparison":
        return leaf(spec)
    if kind in ("all", "any"):
        children = spec.get("conditions") or []
        if not children:
            raise ValueError("conditions must not be empty")
        return fold(kind, [build(c, leaf, depth + 1, nodes) for c in children])
    if kind == "not":
        inner = build(spec["condition"], leaf, depth + 1, nodes)
        return Condition(~inner.value, inner.error)
    raise ValueError(f"unknown condition type: {kind}")


def condition(spec: dict, doc: Document) -> Condition:
    """Condition over the fields of one document (``field`` names the path)."""
    def leaf(node: dict) -> Condition:
        path = check_path(node["field"])
        if path not in doc.fields:
            raise ValueError(f"unknown field path: {path}")
        value = literal(node["value"])
        check_comparison(doc.fields[path].type, node["operator"], value, path)
        column = doc.leaves[path]
        return Condition(
            compare(column, node["operator"], value),
            F.when(doc.absent(path), missing(path, doc.absent_detail(path))))

    return build(spec, leaf)


# Small builders, so rules can be written in Python as well as loaded from JSON.

def comparison(field: str, operator: str, value: dict) -> dict:
    return {"type": "comparison", "field": field, "operator": operator, "value": value}


def all_of(*conditions: dict) -> dict:
    return {"type": "all", "conditions": list(conditions)}


def any_of(*conditions: dict) -> dict:
    return {"type": "any", "conditions": list(conditions)}


def negate(inner: dict) -> dict:
    return {"type": "not", "condition": inner}


def text(value: str) -> dict:
    return {"type": "STRING", "value": value}


def flag(value: bool) -> dict:
    return {"type": "BOOLEAN", "value": value}


def int64(value: int) -> dict:
    return {"type": "INT64", "value": value}


def enum(value: str) -> dict:
    return {"type": "ENUM", "value": value}


def decimal(mantissa: int, scale: int) -> dict:
    return {"type": "FIXED_DECIMAL", "mantissa": mantissa, "scale": scale}


def nanos(value: int) -> dict:
    return {"type": "TIMESTAMP_NANOS", "value": value}
