"""Text rules: symbols, venues, redaction and byte-bounded payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.common import bind

# Patterns of values that must not leave the system, and the replacement.
MESSAGE_SECRET = r"(?i)(password|token|secret|api[_-]?key)\s*[:=]\s*[^,\s]+"
PAYLOAD_SECRET = (r"""(?i)(password|token|secret|api[_-]?key)(?:"|')?\s*[=:]\s*"""
                  r"""(?:"[^"]*"|'[^']*'|[^,\s}]+)""")
REDACTED = "$1=[REDACTED]"
MESSAGE_LIMIT = 512
PREVIEW_LIMIT = 4096
SYMBOL_WIDTH = 8

BLANK = r"^[\s\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]*\z"


def is_blank(text: Column) -> Column:
    """True for empty text and text of white space only."""
    return text.rlike(BLANK)


def pad_symbol(symbol: Column) -> Column:
    """Symbol padded with spaces to its fixed width of eight."""
    return F.rpad(symbol, SYMBOL_WIDTH, " ")


def trim_symbol(symbol: Column) -> Column:
    """Symbol without its padding."""
    return F.rtrim(symbol)


def upper_venue(venue: Column) -> Column:
    """Venue in upper case."""
    return F.upper(venue)


def redact_message(text: Column) -> Column:
    """Safe failure message: one line, secrets replaced, at most 512 characters and ``...``."""
    line = F.when(text.isNull() | is_blank(text), F.lit("unspecified failure")) \
        .otherwise(F.regexp_replace(text, r"[\r\n\t]+", " "))
    return bind(
        F.regexp_replace(line, MESSAGE_SECRET, REDACTED),
        lambda safe: F.when(F.length(safe) <= MESSAGE_LIMIT, safe).otherwise(
            F.concat(F.substring(safe, 1, MESSAGE_LIMIT), F.lit("..."))))


def _payload(encoding: str, value: Column, truncated: Column) -> Column:
    return F.struct(F.lit(encoding).alias("encoding"), truncated.alias("truncated"),
                    value.alias("value"))


def redact_payload(text: Column, max_bytes: int) -> Column:
    """Redacted text cut at a character boundary to at most ``max_bytes`` UTF-8 bytes."""
    def cut(safe: Column) -> Column:
        # A UTF-8 character has at most four bytes, so one of four cuts ends on a boundary.
        cuts = [F.substring(F.encode(safe, "UTF-8"), F.lit(1), F.lit(max(max_bytes - back, 0)))
                .cast("string") for back in range(4)]
        kept = F.when(F.is_valid_utf8(cuts[0]), cuts[0])
        for candidate in cuts[1:3]:
            kept = kept.when(F.is_valid_utf8(candidate), candidate)
        whole = F.octet_length(safe) <= max_bytes
        return _payload("utf-8", F.when(whole, safe).otherwise(kept.otherwise(cuts[3])), ~whole)

    return F.when(text.isNotNull(),
                  bind(F.regexp_replace(text, PAYLOAD_SECRET, REDACTED), cut))


def binary_payload(data: Column, max_bytes: int) -> Column:
    """Base64 of the first ``max_bytes`` bytes."""
    return F.when(
        data.isNotNull(),
        _payload("base64",
                 F.regexp_replace(F.base64(F.substring(data, F.lit(1), F.lit(max_bytes))), "[\r\n]", ""),
                 F.octet_length(data) > max_bytes))


def payload_preview(payload: Column) -> Column:
    """Payload value cut to 4096 characters; ``truncated`` also covers this cut."""
    long = F.length(payload["value"]) > PREVIEW_LIMIT
    return F.when(
        payload.isNotNull(),
        F.struct(payload["encoding"].alias("encoding"),
                 F.substring(payload["value"], 1, PREVIEW_LIMIT).alias("value"),
                 (payload["truncated"] | long).alias("truncated")))
