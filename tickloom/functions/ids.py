"""Stable identifiers and reference text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Domain separators of this library.  A caller that must keep the identifiers of another system passes its own.
EVENT_ID_DOMAIN = "tickloom:event-id:v1"
DEAD_LETTER_DOMAIN = "tickloom:dead-letter:v1"

CANONICAL_SCHEMA_VERSION = "1.0"
PIPELINE_SCHEMA_VERSION = "1.0"


def _int_bytes(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), width * 2, "0"))


def event_id(source: Column, sequence: Column, domain: str = EVENT_ID_DOMAIN) -> Column:
    """SHA-256 hex of domain, NUL, 4-byte length, UTF-8 source and 8-byte big-endian sequence."""
    return F.sha2(
        F.concat(
            F.encode(F.lit(domain), "UTF-8"),
            F.unhex(F.lit("00")),
            _int_bytes(F.octet_length(source).cast("bigint"), 4),
            F.encode(source, "UTF-8"),
            _int_bytes(sequence.cast("bigint"), 8),
        ),
        256,
    )


def failure_id(pipeline_id: Column, pipeline_version: Column, stage: Column, location: Column,
               event: Column, category: Column, message: Column,
               canonical_version: Column | None = None,
               pipeline_schema_version: Column | None = None, domain: str = DEAD_LETTER_DOMAIN) -> Column:
    """SHA-256 hex of ten parts joined by NUL.

    Payload, time and retryability take no part, so a rerun gives the same id.
    """
    canonical_version = F.lit(CANONICAL_SCHEMA_VERSION) if canonical_version is None else canonical_version
    pipeline_schema_version = (F.lit(PIPELINE_SCHEMA_VERSION) if pipeline_schema_version is None
                               else pipeline_schema_version)
    return F.sha2(
        F.concat_ws(
            "\u0000", F.lit(domain), pipeline_id, pipeline_version, stage, location,
            F.coalesce(event, F.lit("")), category, message, canonical_version,
            pipeline_schema_version,
        ),
        256,
    )


def csv_reference(source: Column, row: Column) -> Column:
    """``csv:<source>:row:<line>``."""
    return F.concat(F.lit("csv:"), source, F.lit(":row:"), row.cast("string"))


def frame_reference(source: Column, frame: Column) -> Column:
    """``stp:<source>:frame:<n>``."""
    return F.concat(F.lit("stp:"), source, F.lit(":frame:"), frame.cast("string"))
