"""Declarative transformation: ten operations folded into one projection.

``apply_transformation`` adds ``document`` (the transformed event), ``_status`` (TRANSFORMED,
FILTERED, FAILED) and ``_failure``.  Checks on names and types are made once, from the frame's schema,
and raise ``ValueError``; data-dependent failures mark the row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.common import keep
from tickloom.functions.fixed import (
    fd_parse, fd_parse_error, fd_plain, fd_rescale, fd_rescale_error, fixed, long_parse,
)
from tickloom.functions.text import is_blank
from tickloom.functions.times import nanos_parse
from tickloom.operators.conditions import condition
from tickloom.operators.document import (
    DOCUMENT, Document, Literal, PARENT_ABSENT, current_document, literal,
)
from tickloom.schema import (
    BOOLEAN, ENUM, FAILURE_SCHEMA, FIXED_DECIMAL, Field, INT64, MAX_SCALE, OBJECT, PROTECTED, STRING,
    TIMESTAMP_NANOS, check_path, is_under, parent_of,
)

STATUS = "_status"
FAILURE = "_failure"
OUTCOME = "_outcome"
TRANSFORMED, FILTERED, FAILED = "TRANSFORMED", "FILTERED", "FAILED"

MAX_RULE_OPERATIONS = 256
MAX_ENUM_ENTRIES = 1024

# The supported casts besides identity.
CASTS = {
    STRING: (BOOLEAN, INT64, FIXED_DECIMAL, ENUM, TIMESTAMP_NANOS),
    BOOLEAN: (STRING,),
    INT64: (STRING, FIXED_DECIMAL),
    FIXED_DECIMAL: (STRING,),
    ENUM: (STRING,),
    TIMESTAMP_NANOS: (STRING, INT64),
    OBJECT: (),
}


@dataclass(frozen=True)
class Limits:
    """Per-event limits; a row that breaches one fails."""

    max_operations: int = 256
    max_depth: int = 16
    max_fields: int = 512


# -- failures ---------------------------------------------------------------------------------

def _failed(code: str, index: int, name: str, path: Column | str, detail: Column | str) -> Column:
    def col(x: Column | str) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(FAILED).alias("status"), F.lit(code).alias("code"),
        F.lit(index).alias("operationIndex"), F.lit(name).alias("operationName"),
        col(path).alias("fieldPath"), col(detail).alias("detail"))


def _filtered() -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(FILTERED).alias("status"), none.cast("string").alias("code"),
        none.cast("int").alias("operationIndex"), none.cast("string").alias("operationName"),
        none.cast("string").alias("fieldPath"), none.cast("string").alias("detail"))


# -- casts ------------------------------------------------------------------------------------

def cast_value(value: Column, source: str, target: str) -> tuple[Column, Column]:
    """(cast value, why it failed) of a present value; the value is NULL where it failed."""
    no_error = F.lit(None).cast("string")
    bad_long = F.concat(F.lit('value cannot be converted exactly: For input string: "'), value.cast("string"),
                        F.lit('"')) if source == STRING else no_error
    if source == target or (source, target) in ((ENUM, STRING), (TIMESTAMP_NANOS, INT64)):
        return value, no_error
    if source == STRING and target == BOOLEAN:
        return (F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False)),
                F.lit("boolean text must be exactly true or false"))
    if source == STRING and target == INT64:
        return long_parse(value), bad_long
    if source == STRING and target == FIXED_DECIMAL:
        return fd_parse(value), fd_parse_error(value)
    if source == STRING and target == ENUM:
        return F.when(~is_blank(value), value), F.lit("enum text must not be blank")
    if source == STRING and target == TIMESTAMP_NANOS:
        return nanos_parse(value), F.when(long_parse(value) < 0, F.lit(
            "timestamp nanoseconds must be nonnegative")).otherwise(bad_long)
    if source == INT64 and target == FIXED_DECIMAL:
        return F.when(value.isNotNull(), fixed(value, 0)), no_error
    if source == FIXED_DECIMAL and target == STRING:
        return fd_plain(value), no_error
    return value.cast("string"), no_error


# -- checks made once per operation -----------------------------------------------------------

def _require(doc: Document, path: str) -> Field:
    check_path(path)
    if path not in doc.fields:
        raise ValueError(f"UNKNOWN_FIELD: no field {path} at this point of the rules")
    return doc.fields[path]


def _require_writable(path: str, subtree: bool = False) -> None:
    cursor = path
    while cursor:
        if cursor in PROTECTED:
            raise ValueError(f"PROTECTED_FIELD: rules may read {path} but not change it")
        cursor = parent_of(cursor)
    if subtree and any(is_under(p, path) for p in PROTECTED):
        raise ValueError(f"PROTECTED_FIELD: {path} holds a field that rules may not change")


def _require_target(doc: Document, path: str) -> None:
    check_path(path)
    if any(is_under(p, path) for p in doc.fields):
        raise ValueError(f"TARGET_EXISTS: {path} is taken")
    parent = parent_of(path)
    if parent:
        if parent not in doc.fields or doc.fields[parent].type != OBJECT:
            raise ValueError(f"INVALID_TARGET: {path} has no object to stand in")
        _require_writable(parent)


# -- the fold ---------------------------------------------------------------------------------

class _Fold:
    """Walks an operation list over a frame, collecting outcomes in order."""

    def __init__(self, df: DataFrame, limits: Limits):
        self.df = df
        self.doc = current_document(df)
        self.limits = limits
        self.outcomes: list[Column] = []
        self.temporaries: list[str] = []

    def stage(self, value: Column) -> Column:
        """Compute ``value`` once under a temporary name; later operations refer to the name."""
        name = f"__t{len(self.temporaries)}"
        self.temporaries.append(name)
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def fail(self, when: Column, code: str, index: int, name: str, path, detail) -> None:
        self.outcomes.append(F.when(when, _failed(code, index, name, path, detail)))

    def need(self, path: str, index: int, name: str) -> None:
        self.fail(self.doc.absent(path), "MISSING_FIELD", index, name, path,
                  self.doc.absent_detail(path))

    def need_parent(self, path: str, index: int, name: str) -> None:
        above = self.doc.parents_present(path)
        if above is not None:
            self.fail(~above, "MISSING_FIELD", index, name, path, PARENT_ABSENT)

    def check_limits(self, index: int, name: str, path: str) -> None:
        """Only rows of a schema that could exceed a limit are counted."""
        doc, limits = self.doc, self.limits
        deep = [p for p, f in doc.fields.items()
                if f.type == OBJECT and p.count(".") + 1 > limits.max_depth]
        if deep:
            here = F.lit(False)
            for p in deep:
                here = here | ~doc.absent(p)
            self.fail(here, "NESTING_DEPTH_EXCEEDED", index, name, path,
                      f"document nesting depth exceeds configured limit of {limits.max_depth}")
        if len(doc.fields) > limits.max_fields:
            count = F.lit(0)
            for p in doc.fields:
                count = count + F.when(doc.absent(p), 0).otherwise(1)
            self.fail(count > limits.max_fields, "OUTPUT_FIELD_LIMIT_EXCEEDED", index, name, path,
                      f"document field count exceeds configured limit of {limits.max_fields}")

    # each operation --------------------------------------------------------------------------

    def select(self, index: int, op: dict) -> str:
        chosen = list(op["fields"])
        if len(set(chosen)) != len(chosen):
            raise ValueError("DUPLICATE_FIELD: select names a field twice")
        for path in chosen:
            _require(self.doc, path)
        keep = set(chosen) | PROTECTED

        def kept(path: str) -> bool:
            return path in PROTECTED or any(is_under(path, c) for c in chosen) \
                or any(is_under(k, path) for k in keep)

        for path in [p for p in self.doc.fields if not kept(p)]:
            self.doc.fields.pop(path)
            self.doc.leaves.pop(path, None)
            self.doc.present.pop(path, None)
        return "$"

    def rename(self, index: int, op: dict) -> str:
        source, target = op["from"], check_path(op["to"])
        _require(self.doc, source)
        _require_writable(source, subtree=True)
        if is_under(target, source):
            raise ValueError(f"INVALID_TARGET: {target} lies inside what is renamed")
        _require_target(self.doc, target)
        self.need(source, index, "rename")
        doc = self.doc
        moved = {}
        for path in doc.subtree(source):
            new = check_path(target + path[len(source):])
            moved[new] = (replace(doc.fields[path]), doc.leaves.get(path), doc.present.get(path),
                          path in doc.present)
        self.need_parent(target, index, "rename")
        doc.drop(source)
        for new, (entry, leaf, here, is_object) in moved.items():
            doc.fields[new] = entry
            if is_object:
                doc.present[new] = here
            else:
                doc.leaves[new] = leaf
        return source

    def remove(self, index: int, op: dict) -> str:
        path = op["path"]
        _require(self.doc, path)
        _require_writable(path, subtree=True)
        self.need(path, index, "remove")
        self.doc.drop(path)
        return path

    def _add(self, index: int, name: str, path: str, entry: Field, value: Column | None) -> None:
        self.need_parent(path, index, name)
        above = self.doc.parents_present(path)
        self.doc.fields[path] = entry
        if value is None:
            self.doc.present[path] = above
        else:
            self.doc.leaves[path] = value if above is None else F.when(above, value)

    def add_constant(self, index: int, op: dict) -> str:
        path, value = op["path"], literal(op["value"])
        _require_target(self.doc, path)
        self._add(index, "add_constant", path, Field(value.type), value.column())
        return path

    def cast(self, index: int, op: dict) -> str:
        path, target = op["path"], op["toType"]
        entry = _require(self.doc, path)
        _require_writable(path)
        if target != entry.type and target not in CASTS[entry.type]:
            raise ValueError(f"UNSUPPORTED_CAST: no cast leads from {entry.type} to {target}")
        self.need(path, index, "cast")
        if entry.type == OBJECT:
            return path
        before = self.doc.leaves[path]
        value, why = cast_value(before, entry.type, target)
        if value is not before:
            value = self.stage(value)
            if entry.type == STRING:
                self.fail(before.isNotNull() & value.isNull(), "INVALID_CAST", index, "cast", path, why)
        self.doc.leaves[path] = value
        self.doc.fields[path] = replace(entry, type=target)
        return path

    def scale_fixed_decimal(self, index: int, op: dict) -> str:
        path, target = op["path"], op["targetScale"]
        entry = _require(self.doc, path)
        _require_writable(path)
        if entry.type != FIXED_DECIMAL:
            raise ValueError(f"TYPE_MISMATCH: {path} is no decimal to rescale")
        if isinstance(target, bool) or not isinstance(target, int) or not 0 <= target <= MAX_SCALE:
            raise ValueError(f"scale must be between 0 and {MAX_SCALE}")
        self.need(path, index, "scale_fixed_decimal")
        before = self.doc.leaves[path]
        value = self.stage(fd_rescale(before, target))
        self.fail(before.isNotNull() & value.isNull(), "PRECISION_LOSS", index,
                  "scale_fixed_decimal", path,
                  F.concat(F.lit("scale change would lose precision or overflow: "),
                           fd_rescale_error(before, target)))
        self.doc.leaves[path] = value
        return path

    def enum_map(self, index: int, op: dict) -> str:
        path, mapping = op["path"], op["mapping"]
        entry = _require(self.doc, path)
        _require_writable(path)
        if entry.type not in (ENUM, STRING):
            raise ValueError(f"TYPE_MISMATCH: {path} is no text to map")
        if not 1 <= len(mapping) <= MAX_ENUM_ENTRIES:
            raise ValueError(f"enum mapping takes 1..{MAX_ENUM_ENTRIES} entries")
        self.need(path, index, "enum_map")
        before = self.doc.leaves[path]
        value = self.stage(lookup(before, mapping))
        self.fail(before.isNotNull() & value.isNull(), "UNMAPPED_ENUM_VALUE", index, "enum_map", path,
                  F.concat(F.lit("enum mapping has no entry for value: "), before))
        self.doc.leaves[path] = value
        return path

    def filter(self, index: int, op: dict) -> str:
        test = condition(op["condition"], self.doc)
        self._condition_failure(test.error, index, "filter")
        self.outcomes.append(F.when(~test.value, _filtered()))
        return "$"

    def _condition_failure(self, error: Column, index: int, name: str) -> None:
        self.outcomes.append(F.when(error.isNotNull(), _failed(
            "MISSING_FIELD", index, name, error["path"], error["detail"])))

    def create_object(self, index: int, op: dict) -> str:
        path = op["path"]
        _require_target(self.doc, path)
        self._add(index, "create_object", path, Field(OBJECT), None)
        return path

    def conditional_field(self, index: int, op: dict) -> str:
        path = op["path"]
        yes, no = literal(op["whenTrue"]), literal(op["whenFalse"])
        if yes.type != no.type:
            raise ValueError("conditional values must have the same type")
        _require_target(self.doc, path)
        test = condition(op["condition"], self.doc)
        self._condition_failure(test.error, index, "conditional_field")
        value = self.stage(F.when(test.value, yes.column()).otherwise(no.column()))
        self._add(index, "conditional_field", path, Field(yes.type), value)
        return path


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    """Value of a literal map, NULL when it has no entry."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def operations_of(rules: dict | list[dict]) -> list[dict]:
    """Operation list of a rule document (``{"schemaVersion": "1.0", "operations": [..]}``) or a list."""
    if isinstance(rules, dict):
        if rules.get("schemaVersion") != "1.0":
            raise ValueError("transformation schemaVersion must be 1.0")
        rules = rules["operations"]
    if not rules:
        raise ValueError("operations must not be empty")
    if len(rules) > MAX_RULE_OPERATIONS:
        raise ValueError(f"operations exceed {MAX_RULE_OPERATIONS}")
    return list(rules)


_OPS = {
    "select": _Fold.select, "rename": _Fold.rename, "remove": _Fold.remove,
    "add_constant": _Fold.add_constant, "cast": _Fold.cast,
    "scale_fixed_decimal": _Fold.scale_fixed_decimal, "enum_map": _Fold.enum_map,
    "filter": _Fold.filter, "create_object": _Fold.create_object,
    "conditional_field": _Fold.conditional_field,
}


def apply_transformation(df: DataFrame, rules: dict | list[dict], limits: Limits | None = None,
                         keep_filtered: bool = True) -> DataFrame:
    """Fold ``rules`` over the events of ``df``.

    The first failing operation decides the row's outcome, and a row filtered earlier never fails
    later.  ``keep_filtered=False`` drops FILTERED rows; filters at the head of the list then become
    plain row filters, which reach the scan.
    """
    limits = limits or Limits()
    ops = operations_of(rules)
    fold = _Fold(df, limits)
    if STATUS in df.columns:
        # Rows an earlier call filtered or failed keep that outcome.
        fold.outcomes.append(F.when(F.col(STATUS) != TRANSFORMED, F.struct(
            F.col(STATUS).alias("status"),
            *[F.col(f"{FAILURE}.{f.name}").alias(f.name) for f in FAILURE_SCHEMA.fields])))
    if len(ops) > limits.max_operations:
        fold.outcomes.append(_failed(
            "OPERATION_LIMIT_EXCEEDED", 0, "plan", "$",
            f"compiled operation count exceeds configured limit of {limits.max_operations}"))
    fold.check_limits(0, "document_view", "$")
    leading = True
    for index, op in enumerate(ops):
        name = op.get("op")
        if name not in _OPS:
            raise ValueError(f"unknown operation: {name}")
        leading = leading and name == "filter" and not keep_filtered
        if leading and STATUS not in df.columns and len(ops) <= limits.max_operations \
                and len(fold.outcomes) == 2 * index:
            test = condition(op["condition"], fold.doc)
            fold.df = fold.df.filter(test.error.isNotNull() | test.value)
        path = _OPS[name](fold, index, op)
        fold.check_limits(index, name, path)
    out = fold.df.withColumn(OUTCOME, F.coalesce(*fold.outcomes)
                             if fold.outcomes else F.lit(None).cast("struct<status:string>"))
    failed = F.col(OUTCOME)
    failure = F.when(failed["status"] == FAILED, F.struct(
        *[failed[f.name].alias(f.name) for f in FAILURE_SCHEMA.fields])) \
        if fold.outcomes else F.lit(None).cast(FAILURE_SCHEMA)
    names = [c for c in df.columns if c not in (DOCUMENT, STATUS, FAILURE)]
    out = out.select(
        *[F.col(f"`{c}`") for c in names],
        fold.doc.struct().alias(DOCUMENT),
        F.coalesce(failed["status"], F.lit(TRANSFORMED)).alias(STATUS),
        failure.alias(FAILURE))
    return out if keep_filtered else keep(out, F.col(STATUS) != FILTERED)


# -- one function per operation ---------------------------------------------------------------

def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keep the listed paths, their ancestors and every protected field.

    Documented meaning: unselected siblings below a kept ancestor are gone from the document.
    """
    return apply_transformation(df, [{"op": "select", "fields": fields}])


def rename_field(df: DataFrame, source: str, target: str) -> DataFrame:
    """Move a field or subtree; an absent source fails the row with MISSING_FIELD."""
    return apply_transformation(df, [{"op": "rename", "from": source, "to": target}])


def remove_field(df: DataFrame, path: str) -> DataFrame:
    """Drop a field or subtree; an absent one fails the row with MISSING_FIELD."""
    return apply_transformation(df, [{"op": "remove", "path": path}])


def add_constant(df: DataFrame, path: str, value: dict) -> DataFrame:
    """Add a typed literal under an existing object; an absent parent fails the row."""
    return apply_transformation(df, [{"op": "add_constant", "path": path, "value": value}])


def cast_field(df: DataFrame, path: str, target: str) -> DataFrame:
    """Cast a field; a value that cannot be converted exactly fails with INVALID_CAST."""
    return apply_transformation(df, [{"op": "cast", "path": path, "toType": target}])


def scale_decimal(df: DataFrame, path: str, scale: int) -> DataFrame:
    """Change the scale of a fixed decimal; lost digits or overflow fail with PRECISION_LOSS."""
    return apply_transformation(df, [{"op": "scale_fixed_decimal", "path": path, "targetScale": scale}])


def map_enum(df: DataFrame, path: str, mapping: dict[str, str]) -> DataFrame:
    """Replace a value through a literal map; no entry fails with UNMAPPED_ENUM_VALUE."""
    return apply_transformation(df, [{"op": "enum_map", "path": path, "mapping": mapping}])


def filter_events(df: DataFrame, cond: dict, keep_filtered: bool = True) -> DataFrame:
    """Mark (or drop) rows whose condition is false; a missing field fails the row."""
    return apply_transformation(df, [{"op": "filter", "condition": cond}], keep_filtered=keep_filtered)


def create_object(df: DataFrame, path: str) -> DataFrame:
    """Add an empty object.  Parquet cannot store it while it stays empty."""
    return apply_transformation(df, [{"op": "create_object", "path": path}])


def conditional_field(df: DataFrame, path: str, cond: dict, when_true: dict,
                      when_false: dict) -> DataFrame:
    """Add a field that takes one of two literals of the same type."""
    return apply_transformation(df, [{"op": "conditional_field", "path": path, "condition": cond,
                                      "whenTrue": when_true, "whenFalse": when_false}])


def field(path: str) -> Column:
    """Column of a dotted path after checking the path rules."""
    return F.col(check_path(path))


def transformed(df: DataFrame) -> DataFrame:
    """Rows that passed every operation."""
    return keep(df, F.col(STATUS) == TRANSFORMED)


def failed(df: DataFrame) -> DataFrame:
    """Rows with a failure."""
    return keep(df, F.col(STATUS) == FAILED)
