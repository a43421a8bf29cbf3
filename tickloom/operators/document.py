"""The document an operation list works on: one Column per field path.

Operations only move, replace or drop entries here; the struct is put together once at the end, so a
long list of operations is one narrow stage and never a tower of struct rewrites.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.functions.fixed import fixed
from tickloom.schema import (
    CANONICAL_FIELDS, ENUM, FIXED_DECIMAL, Field, INT64, BOOLEAN, MAX_LONG, MAX_SCALE, MIN_LONG,
    OBJECT, PROTECTED, STRING, TIMESTAMP_NANOS, logical_type, parent_of,
)

ROOTS = ("metadata", "instrument", "payload")
DOCUMENT = "document"

# Failure details that also enter the stable failure id.
FIELD_ABSENT = "field is absent from this event"
PARENT_ABSENT = "object parent is absent from this event"


@dataclass
class Document:
    """Catalog, leaf Columns and presence Columns (``None`` = always there) of a document."""

    fields: dict[str, Field]
    leaves: dict[str, Column] = dc_field(default_factory=dict)
    present: dict[str, Column | None] = dc_field(default_factory=dict)

    def absent(self, path: str) -> Column:
        """True where the field is missing from the row."""
        if self.fields[path].type == OBJECT:
            here = self.present[path]
            return F.lit(False) if here is None else ~here
        return self.leaves[path].isNull()

    def parents_present(self, path: str) -> Column | None:
        """All objects above ``path`` exist, or ``None`` when that holds in every row."""
        out: Column | None = None
        cursor = parent_of(path)
        while cursor:
            here = self.present.get(cursor)
            if here is not None:
                out = here if out is None else out & here
            cursor = parent_of(cursor)
        return out

    def absent_detail(self, path: str) -> Column:
        above = self.parents_present(path)
        if above is None:
            return F.lit(FIELD_ABSENT)
        return F.when(~above, F.lit(PARENT_ABSENT)).otherwise(F.lit(FIELD_ABSENT))

    def subtree(self, path: str) -> list[str]:
        return [p for p in self.fields if p == path or p.startswith(path + ".")]

    def drop(self, path: str) -> None:
        for p in self.subtree(path):
            self.fields.pop(p)
            self.leaves.pop(p, None)
            self.present.pop(p, None)

    def value(self, path: str) -> Column:
        """Leaf Column, or the struct built from everything below an object path."""
        if self.fields[path].type != OBJECT:
            return self.leaves[path]
        built = F.struct(*self._members(path))
        here = self.present[path]
        return built if here is None else F.when(here, built)

    def _members(self, prefix: str) -> list[Column]:
        return [
            self.value(p).alias(p.rpartition(".")[2], metadata={"logical": f.type})
            for p, f in self.fields.items() if parent_of(p) == prefix
        ]

    def struct(self) -> Column:
        return F.struct(*self._members(""))


def _walk(struct: T.StructType, path: str, base: str, doc: Document) -> None:
    for f in struct.fields:
        here = f"{path}.{f.name}" if path else f.name
        column = F.col(f"{base}.{here}" if base else here)
        kind = f.metadata.get("logical")
        known = CANONICAL_FIELDS.get(here)
        if kind is None:
            seen = logical_type(f.dataType)
            same = known is not None and {seen, known.type} in (
                {STRING}, {STRING, ENUM}, {INT64}, {INT64, TIMESTAMP_NANOS}, {BOOLEAN},
                {FIXED_DECIMAL}, {OBJECT})
            kind = known.type if same else seen
        doc.fields[here] = Field(kind, here in PROTECTED)
        if kind == OBJECT:
            # Envelope objects and the three roots exist in every event.
            fixed_part = here in ROOTS or here in PROTECTED
            doc.present[here] = None if fixed_part else column.isNotNull()
            _walk(f.dataType, here, base, doc)
        else:
            doc.leaves[here] = column


def canonical_document(df: DataFrame) -> Document:
    """Document over the canonical columns of ``df``."""
    doc = Document({})
    _walk(T.StructType([df.schema[r] for r in ROOTS if r in df.columns]), "", "", doc)
    return doc


def current_document(df: DataFrame) -> Document:
    """Document a rule sees: the transformed one when ``df`` has it, else the canonical one."""
    if DOCUMENT not in df.columns:
        return canonical_document(df)
    doc = Document({})
    _walk(df.schema[DOCUMENT].dataType, "", DOCUMENT, doc)
    return doc


@dataclass(frozen=True)
class Literal:
    """A typed constant of a rule."""

    type: str
    value: object = None
    mantissa: int = 0
    scale: int = 0

    def column(self) -> Column:
        if self.type == FIXED_DECIMAL:
            return fixed(self.mantissa, self.scale)
        if self.type in (INT64, TIMESTAMP_NANOS):
            return F.lit(self.value).cast("bigint")
        return F.lit(self.value)


def _long(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not MIN_LONG <= value <= MAX_LONG:
        raise ValueError(f"{what} must be an exact integer in the signed 64-bit range")
    return value


def literal(spec: dict) -> Literal:
    """``{"type": "INT64", "value": 5}`` or ``{"type": "FIXED_DECIMAL", "mantissa": .., "scale": ..}``."""
    kind = spec.get("type")
    allowed = {"type", "mantissa", "scale"} if kind == FIXED_DECIMAL else {"type", "value"}
    if set(spec) != allowed:
        raise ValueError(f"typed value of {kind} takes exactly {sorted(allowed)}")
    if kind == FIXED_DECIMAL:
        scale = _long(spec["scale"], "scale")
        if not 0 <= scale <= MAX_SCALE:
            raise ValueError(f"scale must be between 0 and {MAX_SCALE}")
        return Literal(kind, None, _long(spec["mantissa"], "mantissa"), scale)
    value = spec["value"]
    if kind in (STRING, ENUM):
        if not isinstance(value, str) or (kind == ENUM and not value.strip()):
            raise ValueError(f"{kind} value must be text" + (" and not blank" if kind == ENUM else ""))
    elif kind == BOOLEAN:
        if not isinstance(value, bool):
            raise ValueError("BOOLEAN value must be true or false")
    elif kind in (INT64, TIMESTAMP_NANOS):
        _long(value, "value")
        if kind == TIMESTAMP_NANOS and value < 0:
            raise ValueError("timestamp nanoseconds must be nonnegative")
    else:
        raise ValueError(f"unsupported typed value: {kind}")
    return Literal(kind, value)
