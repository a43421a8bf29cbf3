"""Checks on JSON documents held in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.text import is_blank
from tickloom.functions.jsontext import json_line
from tickloom.operators.document import ROOTS

# Parts of a key name that mark a credential.
CREDENTIAL_PARTS = ("password", "secret", "token", "api_key", "apikey", "credential")

_KEY = r'"((?:[^"\\]|\\.)*+)"\s*:'


def credential_keys(json: Column) -> Column:
    """Sorted distinct key names, at any depth, that look like credentials.

    A key is a string followed by a colon; text inside values is passed over, because the pattern
    consumes whole strings.
    """
    tokens = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*+"\s*:?)'), F.lit(1))
    keys = F.transform(F.filter(tokens, lambda t: t.endswith(":")),
                       lambda t: _decoded(F.regexp_extract(t, _KEY, 1)))
    parts = "|".join(CREDENTIAL_PARTS)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.lower(k).rlike(parts))))


def _decoded(key: Column) -> Column:
    """Key name with its JSON escapes resolved."""
    return F.when(key.contains("\\"), F.get_json_object(
        F.concat(F.lit('["'), key, F.lit('"]')), "$[0]")).otherwise(key)


def find_credential_keys(df: DataFrame, column: str) -> DataFrame:
    """Add ``credential_keys``; NULL when the text is no JSON."""
    valid = F.try_parse_json(F.col(column)).isNotNull()
    return df.withColumn("credential_keys", F.when(valid, credential_keys(F.col(column))))


def check_document(df: DataFrame, column: str) -> DataFrame:
    """Add ``document_issue``: the text must be a JSON object with a non-blank text ``$schema``."""
    doc = F.try_parse_json(F.col(column))
    dialect = F.try_variant_get(doc, "$['$schema']", "variant")
    text = F.try_variant_get(doc, "$['$schema']", "string")
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    is_text = F.coalesce(F.schema_of_variant(dialect) == "STRING", F.lit(False))
    return df.withColumn("document_issue", F.when(
        F.col(column).isNull() | F.coalesce(F.is_variant_null(doc), F.lit(False)), "document is required")
        .when(~is_object, "document must be a JSON object")
        .when(~is_text | is_blank(text), "document.$schema is required to identify the JSON Schema dialect"))


def field_at(path: str) -> Column:
    """Nested field of an event, NULL when any part is absent."""
    from tickloom.schema import check_path

    return F.col(check_path(path))


def event_json(df: DataFrame) -> Column:
    """Canonical event of a frame as JSON text with sorted keys and absent fields left out."""
    return json_line(df.schema, [r for r in ROOTS if r in df.columns])
