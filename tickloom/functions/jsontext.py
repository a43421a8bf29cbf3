"""Event documents as JSON text with sorted keys, absent members left out and exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tickloom.functions.fixed import fd_plain
from tickloom.schema import DECIMAL_TYPE

# Escapes of the 32 control characters.
_CONTROL = [f"\\u{code:04x}" for code in range(32)]
_CONTROL[8], _CONTROL[9], _CONTROL[10], _CONTROL[12], _CONTROL[13] = "\\b", "\\t", "\\n", "\\f", "\\r"


def json_string(text: Column) -> Column:
    """``text`` quoted and escaped; text without special characters takes the short way."""
    quoted = F.regexp_replace(text, r'(["\\])', r"\\$1")
    table = F.split(F.lit(" ".join(_CONTROL)), " ")
    controls = F.array_join(
        F.transform(
            F.split(quoted, ""),
            lambda c: F.when((c != "") & (F.ascii(c) < 32),
                             F.element_at(table, F.ascii(c) + F.lit(1))).otherwise(c)),
        "")
    body = (F.when(text.rlike(r"[\x00-\x1f]"), controls)
            .when(text.rlike(r'["\\]'), quoted).otherwise(text))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_object(members: dict[str, Column]) -> Column:
    """Object text from member texts; a NULL member is left out, keys are sorted."""
    parts = [F.concat(json_key(key), members[key]) for key in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def json_key(key: str) -> Column:
    import json

    return F.lit(json.dumps(key, ensure_ascii=False) + ":")


def json_array(items: list[Column]) -> Column:
    """Array text from item texts; NULL items are left out."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")) if items else F.lit("[]")


def json_value(value: Column, dtype: T.DataType) -> Column:
    """JSON text of one value, NULL when it is absent."""
    if dtype == DECIMAL_TYPE or _is_decimal(dtype):
        return fd_plain(value)
    if isinstance(dtype, T.StructType):
        members = {f.name: json_value(value[f.name], f.dataType) for f in dtype.fields}
        return F.when(value.isNotNull(), json_object(members))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: json_value(item, dtype.elementType))
        return F.when(value.isNotNull(),
                      F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(dtype, T.StringType):
        return json_string(value)
    if isinstance(dtype, (T.BooleanType, T.LongType, T.IntegerType)):
        return value.cast("string")
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    raise ValueError(f"unsupported output value type: {dtype.simpleString()}")


def _is_decimal(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and [f.name for f in dtype.fields] == ["mantissa", "scale"]


def json_line(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """One JSON Lines record from the named columns of a frame (all by default)."""
    chosen = [f for f in schema.fields if columns is None or f.name in columns]
    return json_object({f.name: json_value(F.col(f"`{f.name}`"), f.dataType) for f in chosen})
