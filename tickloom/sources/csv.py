"""Mapped CSV trades, read as text so that blank rows, quoting errors and row numbers stay exact.

A quote inside a well-formed file always toggles "inside quotes", so the number of quotes before a
line tells whether the line starts a record.  That count is a prefix sum over blocks, and every line's
syntax can be checked on its own; everything after a file's first bad row is dropped, so only
well-formed lines are ever put together to records.
"""

from __future__ import annotations

from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.functions.common import keep
from tickloom.functions.fixed import fixed, long_parse, price_at_scale
from tickloom.functions.ids import csv_reference, event_id
from tickloom.functions.text import trim_symbol, upper_venue
from tickloom.functions.times import iso_parse, nanos_parse
from tickloom.operators.transform import lookup
from tickloom.operators.validate import issue, source_problem, symbol_problem, venue_problem
from tickloom.schema import EVENT_SCHEMA, MAX_QUANTITY, MAX_SCALE
from tickloom.sources.jsonl import CONTINUE, FAIL_FAST
from tickloom.sources.lines import BLOCK, FILE, ROW, block_bound, maybe_broadcast, read_lines, until_first_error

MALFORMED_ROW = "MALFORMED_ROW"
MISSING_COLUMN = "MISSING_COLUMN"
BAD_CONFIGURATION = "INVALID_CONFIGURATION"

# Syntax error texts.
NOT_CLOSED = "quoted field is not closed"
AFTER_CLOSE = "characters after a closing quote must be a delimiter or line break"
QUOTE_INSIDE = "quote must begin a field"


@dataclass(frozen=True)
class CsvConfig:
    """Explicit column mapping.  Columns are header names, or zero-based indexes without a header."""

    source: str
    timestamp_column: str
    symbol_column: str
    quantity_column: str
    side_column: str
    side_mapping: dict[str, str] = field(hash=False, default_factory=dict)
    price_scale: int = 2
    decimal_price_column: str | None = None
    price_mantissa_column: str | None = None
    venue_column: str | None = None
    constant_venue: str | None = None
    timestamp_format: str = "EPOCH_NANOS"
    delimiter: str = ","
    has_header: bool = True

    def __post_init__(self) -> None:
        if len(self.delimiter) != 1 or self.delimiter in '"\r\n\0':
            raise ValueError("the delimiter is one character, neither a quote nor NUL")
        if self.timestamp_format not in ("EPOCH_NANOS", "ISO_INSTANT"):
            raise ValueError(f"no timestamp format {self.timestamp_format}")
        if (self.venue_column is None) == (self.constant_venue is None):
            raise ValueError("give the venue either by column or as a constant")
        if (self.price_mantissa_column is None) == (self.decimal_price_column is None):
            raise ValueError("give the price either by mantissa or as a decimal")
        if not 0 <= self.price_scale <= MAX_SCALE:
            raise ValueError(f"the price scale lies in 0..{MAX_SCALE}")
        if not self.side_mapping or set(self.side_mapping.values()) - {"BUY", "SELL"}:
            raise ValueError("the side mapping needs entries, each to BUY or SELL")
        for name in ("timestamp_column", "symbol_column", "quantity_column", "side_column"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} is missing")

    @staticmethod
    def from_dict(spec: dict) -> "CsvConfig":
        """Config from the camel-case keys of a JSON mapping file."""
        snake = {re.sub("[A-Z]", lambda m: "_" + m.group().lower(), k): v for k, v in spec.items()}
        return CsvConfig(**snake)

    def columns(self) -> list[tuple[str, str]]:
        """(column, description) of the mapped columns in the order they are read."""
        out = [(self.timestamp_column, "timestamp"), (self.symbol_column, "symbol")]
        if self.venue_column is not None:
            out.append((self.venue_column, "venue"))
        if self.price_mantissa_column is not None:
            out.append((self.price_mantissa_column, "price mantissa"))
        else:
            out.append((self.decimal_price_column, "decimal price"))
        return out + [(self.quantity_column, "quantity"), (self.side_column, "side")]


# -- cells to events --------------------------------------------------------------------------

def trade_columns(cells: dict[str, Column], ordinal: Column, row: Column, config: CsvConfig) -> dict[str, Column]:
    """Event columns and ``_issue`` of one row's cells, keyed by the mapped descriptions.

    A NULL cell is a column the row does not have.  The first failing column, in reading order,
    gives the reason.  Sequence number and trade id are the data row's ordinal, failed rows included.
    """
    source = F.lit(config.source)
    time_text = cells["timestamp"]
    at = nanos_parse(time_text) if config.timestamp_format == "EPOCH_NANOS" else iso_parse(time_text)
    venue = F.lit(config.constant_venue) if config.venue_column is None else cells["venue"]
    if config.price_mantissa_column is not None:
        price_name, price_detail = "price mantissa", "invalid price mantissa"
        mantissa = long_parse(cells[price_name])
    else:
        price_name, price_detail = "decimal price", "decimal price is not exact at configured scale"
        mantissa = price_at_scale(cells[price_name], config.price_scale)
    quantity = long_parse(cells["quantity"])
    side = lookup(cells["side"], config.side_mapping)

    def absent(name: str) -> Column:
        return F.when(cells[name].isNull(), issue(MISSING_COLUMN, f"{name} column is not present in row"))

    rules = [
        absent("timestamp"),
        F.when(F.col("__at").isNull(), issue("INVALID_TIMESTAMP", f"invalid {config.timestamp_format} timestamp")),
        absent("symbol"),
        F.when(symbol_problem(cells["symbol"]).isNotNull(), issue("INVALID_SYMBOL", "invalid instrument symbol")),
    ]
    if config.venue_column is not None:
        rules += [absent("venue"),
                  F.when(venue_problem(venue).isNotNull(), issue("INVALID_VENUE", "invalid venue"))]
    rules += [
        absent(price_name),
        F.when(F.col("__mantissa").isNull(), issue("INVALID_DECIMAL", price_detail)),
        absent("quantity"),
        F.when(F.col("__quantity").isNull() | ~F.col("__quantity").between(1, MAX_QUANTITY),
               issue("INVALID_QUANTITY", "invalid quantity")),
        absent("side"),
        F.when(F.col("__side").isNull(), issue(
            "INVALID_SIDE", "side value is not present in configured enum mapping")),
    ]
    types = {f.name: f.dataType for f in EVENT_SCHEMA["payload"].dataType.fields}
    given = {"type": F.lit("TRADE"), "tradeId": ordinal.cast("bigint"),
             "aggressorSide": F.col("__side"), "quantity": F.col("__quantity"),
             "price": fixed(F.col("__mantissa"), config.price_scale)}
    payload = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    metadata = F.struct(
        event_id(source, ordinal).alias("eventId"),
        F.struct(F.lit(1).cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor"))
        .alias("schemaVersion"),
        source.alias("source"), upper_venue(venue).alias("venue"), F.col("__at").alias("exchangeTimestamp"),
        F.lit(None).cast("bigint").alias("receiveTimestamp"),
        ordinal.cast("bigint").alias("sequenceNumber"),
        csv_reference(source, row).alias("rawEventReference"))
    return {
        "__at": at, "__mantissa": mantissa, "__quantity": quantity, "__side": side,
        "_issue": F.coalesce(*rules), "metadata": metadata,
        "instrument": F.struct(trim_symbol(cells["symbol"]).alias("symbol")), "payload": payload,
    }


def map_trades(df: DataFrame, cells: dict[str, Column], ordinal: Column, row: Column,
               config: CsvConfig) -> DataFrame:
    """Add metadata, instrument, payload and ``_issue`` to a frame whose columns hold the cells."""
    if config.constant_venue is not None:
        bad = df.sparkSession.range(1).select(venue_problem(F.lit(config.constant_venue))).first()[0]
        if bad:
            raise ValueError(bad)
    columns = trade_columns(cells, ordinal, row, config)
    staged = df.withColumns({n: c for n, c in columns.items() if n.startswith("__")})
    return staged.withColumns({n: c for n, c in columns.items() if not n.startswith("__")}) \
        .drop(*[n for n in columns if n.startswith("__")])


# -- text to records --------------------------------------------------------------------------

def _patterns(delimiter: str) -> dict[str, str]:
    d = re.escape(delimiter)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    plain = f'[^"{d}]*+'
    cell = f"(?:{quoted}|{plain})"
    whole = f"{cell}(?:{d}{cell})*+"
    opened = r'"[^"]*+(?:""[^"]*+)*+'
    rest = r'[^"]*+(?:""[^"]*+)*+'
    return {
        # A line that starts a record: complete, or ending inside a quoted cell.
        "complete": rf"^{whole}\z",
        "opening": rf"^(?:{cell}{d})*+{opened}\z",
        # A line that starts inside a quoted cell: stays inside, closes, or closes and opens again.
        "inside": rf"^{rest}\z",
        "closing": rf'^{rest}"(?:{d}{cell})*+\z',
        "reopening": rf'^{rest}"{d}(?:{cell}{d})*+{opened}\z',
        "cells": rf"(?:^|{d})({cell})",
        # Used only to word the error: a closed cell followed by something else.
        "after": rf'^(?:{cell}{d})*+{quoted}[^"{d}]',
    }


def _syntax(df: DataFrame, config: CsvConfig) -> DataFrame:
    """Add ``__bad`` (error text or NULL) to lines that know whether they start inside quotes."""
    p = _patterns(config.delimiter)
    line, inside = F.col("value"), F.col("__inside")
    good_start = line.rlike(p["complete"]) | line.rlike(p["opening"])
    good_inside = line.rlike(p["inside"]) | line.rlike(p["closing"]) | line.rlike(p["reopening"])
    text = F.when(line.rlike(p["after"]) | inside, F.lit(AFTER_CLOSE)).otherwise(F.lit(QUOTE_INSIDE))
    # A line without quotes outside a quoted cell, nearly every line, cannot be wrong.
    good = F.when(~inside & (F.col("__quotes") == 0), F.lit(True)).when(inside, good_inside).otherwise(good_start)
    return df.withColumn("__bad", F.when(good, F.lit(None).cast("string")).otherwise(text))


def _quotes() -> Column:
    """Number of quotes in a line; nearly every line has none."""
    line = F.col("value")
    return F.when(line.contains('"'), F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).otherwise(F.lit(0))


def _numbered(lines: DataFrame) -> DataFrame:
    """Add physical line number, record number and whether the line starts inside quotes."""
    bound = block_bound(lines)
    scan = lines.withColumn("__quotes", _quotes())
    # Running quotes inside a block; a block is bounded by the split size.
    inner = Window.partitionBy(FILE, BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    scan = scan.withColumn("__before", F.coalesce(F.sum("__quotes").over(inner), F.lit(0)))
    odd = (F.col("__before") % 2) == 1
    blocks = scan.groupBy(FILE, BLOCK).agg(
        F.min(ROW).alias("first"), F.count("*").alias("lines"), F.sum("__quotes").alias("quotes"),
        F.count_if(~odd).alias("even"), F.count_if(odd).alias("odd"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("__records", F.when(F.col("__start") == 0, F.col("even"))
                               .otherwise(F.col("odd")))
    offsets = blocks.select(
        FILE, BLOCK, "first", "__start",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("__lines"),
        F.coalesce(F.sum("__records").over(before), F.lit(0)).alias("__records"))
    joined = scan.join(maybe_broadcast(offsets, bound), [FILE, BLOCK])
    starts = ((F.col("__before") + F.col("__start")) % 2) == 0
    through = Window.partitionBy(FILE, BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn("__inside", ~starts)
            .withColumn("line_number", F.col(ROW) - F.col("first") + F.col("__lines") + 1)
            .withColumn("record", F.col("__records")
                        + F.sum(F.when(starts, 1).otherwise(0)).over(through)))


def _plain_records(lines: DataFrame, config: CsvConfig) -> tuple[DataFrame, DataFrame]:
    """(records, syntax errors) of lines that are one record each.

    All that a line needs to know of others is one row of whole numbers per block: the lines before the block, and
    the first bad line of the file.  So lines are neither sorted nor shuffled, and nothing but quotes is looked at for it.
    """
    scan = _syntax(lines.withColumns({"__quotes": _quotes(), "__inside": F.lit(False)}), config)
    wrong = F.when(F.col("__quotes") > 0, F.coalesce("__bad", F.when(F.col("__quotes") % 2 == 1, F.lit(NOT_CLOSED))))
    scan = scan.select(FILE, BLOCK, ROW, "value", wrong.alias("__wrong"))
    blocks = scan.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("first"), F.count("*").alias("lines"),
                                           F.min(F.when(F.col("__wrong").isNotNull(), F.col(ROW))).alias("wrong"))
    whole = Window.partitionBy(FILE)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("__offset", F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1)
    offsets = offsets.select(FILE, BLOCK, "__offset", F.min(F.col("wrong") + F.col("__offset")).over(whole).alias("__stop"))
    numbered = scan.join(maybe_broadcast(offsets, block_bound(lines)), [FILE, BLOCK]) \
        .withColumn("record", F.col(ROW) + F.col("__offset"))
    errors = numbered.filter(F.col("__wrong").isNotNull() & (F.col("record") == F.col("__stop"))).select(
        FILE, F.col("record").alias("row"), F.lit(MALFORMED_ROW).alias("reason"), F.col("__wrong").alias("detail"),
        F.lit("").alias("source_text"))
    good = numbered.filter(F.col("__stop").isNull() | (F.col("record") < F.col("__stop")))
    return good.select(FILE, "record", F.col("record").alias("row"), F.col("value").alias("source_text")), errors


def read_csv_records(spark: SparkSession, path: str | list[str], config: CsvConfig,
                     quoted_line_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, syntax errors): cells of every well-formed record before a file's first bad one.

    ``quoted_line_breaks=False`` states that no cell holds a line break; lines then need no shuffle,
    and a quote left open is an error of its own line.
    """
    # Only line feeds split; a carriage return before one belongs to the line break.
    lines = read_lines(spark, path, line_sep="\n")
    value = F.col("value")
    lines = lines.withColumn("value", F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value))
    if not quoted_line_breaks:
        records, errors = _plain_records(lines, config)
        return _with_cells(records, config), errors
    numbered = _syntax(_numbered(lines), config)
    ends_inside = F.when(F.col("__inside"), (F.col("__quotes") % 2) == 0).otherwise((F.col("__quotes") % 2) == 1)
    marks = numbered.withColumn("__open", ends_inside)
    # One row per file: its first bad record, and the last record when its quote never closes.
    last = F.max_by(F.col("__open"), F.col("line_number"))
    per_file = marks.groupBy(FILE).agg(
        F.min(F.when(F.col("__bad").isNotNull(), F.struct(
            F.col("record"), F.col("__bad").alias("detail")))).alias("bad"),
        F.when(last, F.struct(F.max("record").alias("record"), F.lit(NOT_CLOSED).alias("detail")))
        .alias("open"))
    stop = per_file.select(FILE, F.least(F.col("bad"), F.col("open")).alias("__stop"))
    files = len(lines.inputFiles())
    kept = marks.join(maybe_broadcast(stop, files), FILE)
    errors = (kept.filter(F.col("record") == F.col("__stop.record")).groupBy(FILE)
              .agg(F.min("line_number").alias("row"), F.first("__stop.detail").alias("detail")))
    errors = errors.select(FILE, "row", F.lit(MALFORMED_ROW).alias("reason"), "detail",
                           F.lit("").alias("source_text"))
    good = kept.filter(F.col("__stop").isNull() | (F.col("record") < F.col("__stop.record")))
    single = good.filter(~F.col("__inside") & ~F.col("__open")).select(
        FILE, "record", F.col("line_number").alias("row"), F.col("value").alias("source_text"))
    # Only lines of records that span line breaks are grouped, by file and record.
    several = good.filter(F.col("__inside") | F.col("__open")).groupBy(FILE, "record").agg(
        F.min("line_number").alias("row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "value"))),
                                 lambda x: x["value"]), "\n").alias("source_text"))
    return _with_cells(single.unionByName(several), config), errors


def _with_cells(records: DataFrame, config: CsvConfig) -> DataFrame:
    raw = F.regexp_extract_all("source_text", F.lit(_patterns(config.delimiter)["cells"]), F.lit(1))
    plain = F.split("source_text", re.escape(config.delimiter), -1)
    cells = F.when(F.col("source_text").contains('"'), F.transform(raw, _unquote)).otherwise(plain)
    return records.withColumn("cells", cells)


def _unquote(cell: Column) -> Column:
    inner = F.substring(cell, F.lit(2), F.length(cell) - F.lit(2))
    return F.when(cell.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)


def _header_issue(headers: Column, config: CsvConfig) -> Column:
    """Duplicate header, or the first mapped column the header does not have."""
    duplicate = F.filter(headers, lambda h: F.size(F.filter(headers, lambda x: x == h)) > 1)
    rules = [F.when(F.size(duplicate) > 0, issue(
        BAD_CONFIGURATION, F.concat(F.lit("duplicate CSV header: "), F.get(duplicate, F.lit(0)))))]
    for name, _ in config.columns():
        rules.append(F.when(~F.array_contains(headers, name),
                            issue(MISSING_COLUMN, f"CSV header is missing column: {name}")))
    return F.coalesce(*rules)


def read_trades_csv(spark: SparkSession, path: str | list[str], config: CsvConfig,
                    mode: str = CONTINUE, quoted_line_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of mapped CSV files; every file brings its own header.

    Errors say in ``counted`` whether they are data rows: syntax errors and header errors are none.
    A lone carriage return is no line break here.
    """
    if mode not in (CONTINUE, FAIL_FAST):
        raise ValueError(f"unknown mode: {mode}")
    records, syntax = read_csv_records(spark, path, config, quoted_line_breaks)
    if source_bad := spark.range(1).select(source_problem(F.lit(config.source))).first()[0]:
        raise ValueError(source_bad)
    if config.has_header:
        files = len(records.inputFiles())
        # One row per file.  The observed count keeps the checks of a header above this filter; Spark would move them
        # below the join that numbers the lines and check every line as if it were a header.
        heads = records.filter(F.col("record") == 1).select(
            FILE, F.col("cells").alias("__header"), F.col("row").alias("__hrow"),
            F.col("source_text").alias("__htext"))
        heads = keep(heads, F.col(FILE).isNotNull())
        heads = heads.withColumn("__hissue", _header_issue(F.col("__header"), config))
        header_errors = heads.filter(F.col("__hissue").isNotNull()).select(
            FILE, F.col("__hrow").alias("row"), F.col("__hissue.reason").alias("reason"),
            F.col("__hissue.detail").alias("detail"), F.col("__htext").alias("source_text"))
        # Positions of the mapped columns, once per file.
        places = F.array(*[F.array_position(F.col("__header"), n).cast("int") - F.lit(1)
                           for n, _ in config.columns()])
        good = heads.filter(F.col("__hissue").isNull()).select(FILE, places.alias("__places"))
        rows = (records.filter(F.col("record") > 1).join(maybe_broadcast(good, files), FILE)
                .withColumn("ordinal", F.col("record") - 1))
        # A file with a bad header reports that alone.
        syntax = syntax.join(maybe_broadcast(header_errors.select(FILE), files), FILE, "left_anti")
        no_rows = header_errors.unionByName(syntax)

        place = {n: i for i, (n, _) in enumerate(config.columns())}

        def cell(name: str) -> Column:
            return F.get(F.col("cells"), F.col("__places")[place[name]])
    else:
        rows, no_rows = records.withColumn("ordinal", F.col("record")), syntax

        def cell(name: str) -> Column:
            return F.get(F.col("cells"), F.lit(int(name))) if name.isdigit() else F.lit(None).cast("string")

    named = [(d, cell(n)) for n, d in config.columns()]
    staged = rows.withColumns({f"cell {d}": c for d, c in named})
    parsed = map_trades(staged, {d: F.col(f"`cell {d}`") for d, _ in named}, F.col("ordinal"), F.col("row"), config)
    bad_index = next((d for n, d in config.columns() if not config.has_header and not n.isdigit()), None)
    if bad_index is not None:
        parsed = parsed.withColumn("_issue", issue(
            BAD_CONFIGURATION,
            f"{bad_index} must be a nonnegative zero-based column index when no header is present"))
    parsed = parsed.drop(*[f"cell {d}" for d, _ in named], "cells", "__places", "record")
    if mode == FAIL_FAST:
        failing = keep(parsed, F.col("_issue").isNotNull())
        first = failing.groupBy(FILE).agg(F.min("row").alias("__cut"))
        parsed = until_first_error(parsed, failing, "row")
        no_rows = no_rows.join(first, FILE, "left").filter(
            F.col("__cut").isNull() | (F.col("row") <= F.col("__cut"))).drop("__cut")
    location = F.concat(F.col(FILE), F.lit(":row "), F.col("row").cast("string"))
    events = keep(parsed, F.col("_issue").isNull()).drop("_issue") \
        .withColumn("source_location", location)
    row_errors = keep(parsed, F.col("_issue").isNotNull()).select(
        FILE, "row", F.col("_issue.reason").alias("reason"), F.col("_issue.detail").alias("detail"),
        "source_text", F.lit(True).alias("counted"))
    errors = row_errors.unionByName(no_rows.withColumn("counted", F.lit(False))) \
        .withColumn("source_location", location)
    return events, errors
