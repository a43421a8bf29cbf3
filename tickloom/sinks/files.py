"""JSON Lines and CSV output with publish-on-success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.functions.fixed import fd_plain
from tickloom.functions.jsontext import json_line, json_value
from tickloom.operators.blueprint import OUTPUT, OUTPUT_JSON
from tickloom.operators.document import DOCUMENT, ROOTS
from tickloom.schema import DEAD_LETTER_SCHEMA, check_path, logical_type, OBJECT, FIXED_DECIMAL
from tickloom.sinks.publish import Kind, publish, renamed


def record_line(df: DataFrame) -> Column:
    """JSON line of a row: the rendered blueprint, else the transformed document, else the event."""
    if OUTPUT_JSON in df.columns:
        return F.col(OUTPUT_JSON)
    if DOCUMENT in df.columns:
        return json_value(F.col(DOCUMENT), df.schema[DOCUMENT].dataType)
    roots = [r for r in ROOTS if r in df.columns]
    return json_line(df.schema, roots or None)


def write_jsonl(df: DataFrame, path: str, kind: Kind = renamed) -> None:
    """One record per line, keys sorted at every level, absent fields left out."""
    lines = df.select(record_line(df).alias("value"))
    publish(df.sparkSession, path, lambda to: lines.write.text(to), kind)


def csv_columns(df: DataFrame, columns: list[tuple[str, str]]) -> list[Column]:
    """Text cells for (header, dotted path) pairs; an absent field is an empty cell.

    An object or array in a cell is an error, known from the schema.
    """
    base = next((c for c in (OUTPUT, DOCUMENT) if c in df.columns), None)
    root = df.schema[base].dataType if base else T.StructType(
        [df.schema[r] for r in ROOTS if r in df.columns] or df.schema.fields)
    cells = []
    for header, path in columns:
        dtype: T.DataType = root
        for segment in check_path(path).split("."):
            inside = isinstance(dtype, T.StructType) and segment in dtype.names
            dtype = dtype[segment].dataType if inside else None
            if dtype is None:
                break
        if dtype is None:
            cells.append(F.lit("").alias(header))
            continue
        if isinstance(dtype, (T.ArrayType, T.VariantType)) or logical_type(dtype) == OBJECT:
            raise ValueError(f"CSV column {header} references a non-scalar value")
        column = F.col(f"{base}.{path}" if base else path)
        text = fd_plain(column) if logical_type(dtype) == FIXED_DECIMAL else column.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(header))
    return cells


def csv_text(cells: DataFrame, path: str, header: bool) -> None:
    """Write text cells as they are; an empty cell is nothing between two commas."""
    cells.write.csv(path, header=header, escape='"', emptyValue="", nullValue="",
                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, columns: list[tuple[str, str]], header: bool = True, kind: Kind = renamed) -> None:
    """Comma-separated cells, quoted only when they hold a comma, quote or line break.

    Every part file of the output carries the header.
    """
    if not columns:
        raise ValueError("CSV output needs at least one column")
    cells = df.select(*csv_columns(df, columns))
    publish(df.sparkSession, path, lambda to: csv_text(cells, to, header), kind)


def write_dead_letters(letters: DataFrame, path: str, kind: Kind = renamed) -> None:
    """Quarantine records as JSON Lines."""
    line = json_line(DEAD_LETTER_SCHEMA)
    publish(letters.sparkSession, path, lambda to: letters.select(line.alias("value")).write.text(to), kind)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Quarantine records read back as rows."""
    return spark.read.schema(DEAD_LETTER_SCHEMA).json(path)
