"""One run: read, transform, shape, write, quarantine, count.

The input is parsed once: a run writes every row with its state, in folders by state, and takes output, dead letters,
counters and the failure sample from the parts of that table that they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from tickloom.functions.common import keep
from tickloom.functions.text import redact_message
from tickloom.operators.blueprint import BLUEPRINT_FAILURE, render_blueprint
from tickloom.operators.deadletter import DeadLetterConfig, FAIL_FAST, SKIP, dead_letters, quarantine
from tickloom.operators.report import COUNTERS, run_counters, sequence_counters
from tickloom.operators.scan import matched
from tickloom.operators.sequence import sequence_integrity
from tickloom.operators.transform import FAILED, FAILURE, FILTERED, STATUS, apply_transformation
from tickloom.operators.validate import normalized
from tickloom.plans.views import scratch
from tickloom.sinks.files import csv_columns, csv_text, record_line, write_dead_letters
from tickloom.sinks.publish import Kind, remove, renamed
from tickloom.sources.capture import split_capture
from tickloom.sources.csv import CsvConfig, read_trades_csv
from tickloom.sources.frames import UNSUPPORTED, decode_columns, normalize_frames
from tickloom.sources.jsonl import CONTINUE, FAIL_FAST as STOP, read_canonical_jsonl, read_jsonl_states
from tickloom.sources.lines import BLOCK, FILE, ROW, block_bound, line_offsets, maybe_broadcast


@dataclass(frozen=True)
class Inputs:
    """Events plus failed rows of the reading stages, or ``parsed``, both in one frame from one scan.

    Events and failures carry ``file_path``, ``position`` and ``source_location``; failures also ``stage``
    and ``detail``.  ``parsed`` carries file, block, scan position and ``_issue``; lines get their numbers when
    they have been written.  ``sequence`` is the classified frame table of binary input.
    """

    events: DataFrame | None
    failures: DataFrame | None
    sequence: DataFrame | None = None
    parsed: DataFrame | None = None


@dataclass(frozen=True)
class Report:
    """Counters, outcome and a bounded sample of failures."""

    counters: dict[str, int]
    outcome: str
    failures: list = field(default_factory=list)
    suppressed: int = 0
    sequence_gap_count: int = 0
    duplicate_count: int = 0


def _failures(df: DataFrame, stage: str, position: str) -> DataFrame:
    detail = F.concat(F.col("reason"), F.lit(": "), F.col("detail"))
    text = F.col("source_text") if "source_text" in df.columns else F.lit(None).cast("string")
    frame = F.col("frame") if "frame" in df.columns else F.lit(None).cast("binary")
    return df.select(FILE, F.col(position).alias("position"), "source_location", F.lit(stage).alias("stage"),
                     detail.alias("detail"), text.alias("source_text"), frame.alias("frame"))


def read_jsonl_input(spark: SparkSession, path: str | list[str], mode: str = CONTINUE) -> Inputs:
    if mode != STOP:
        return Inputs(None, None, parsed=read_jsonl_states(spark, path))
    events, errors = read_canonical_jsonl(spark, path, mode)
    return Inputs(events.withColumnRenamed("line_number", "position"), _failures(errors, "PARSE", "line_number"))


def read_csv_input(spark: SparkSession, path: str, config: CsvConfig, mode: str = CONTINUE) -> Inputs:
    events, errors = read_trades_csv(spark, path, config, mode)
    return Inputs(events.withColumnRenamed("row", "position").drop("ordinal"), _failures(errors, "PARSE", "row"))


def read_capture_input(spark: SparkSession, path: str, source: str, venue: str,
                       max_frame: int = 65537) -> Inputs:
    """Each capture file is one stream for sequence numbers and open orders."""
    split = split_capture(spark, path, max_frame).withColumn("source", F.lit(source)).withColumn(
        "source_location", F.concat(F.col(FILE), F.lit(":frame "), F.col("frame_number").cast("string")))
    framed = split.filter(F.col("reason").isNull()).drop("reason", "detail")
    decoded = decode_columns(framed)
    fine = keep(decoded, F.col("_issue").isNull()).drop("_issue")
    bad = keep(decoded, F.col("_issue").isNotNull()).select(
        FILE, "frame_number", "source_location", "frame",
        F.lit("").alias("reason"), F.col("_issue.detail").alias("detail"))
    framing = split.filter(F.col("reason").isNotNull()).select(
        FILE, "frame_number", "source_location", "frame", F.lit("").alias("reason"), "detail")
    parse = framing.unionByName(bad)
    parse_failures = _failures(parse, "PARSE", "frame_number").withColumn(
        "detail", F.regexp_replace("detail", "^: ", ""))
    events, unresolved = normalize_frames(fine, venue, stream=FILE)
    failures = parse_failures.unionByName(_failures(unresolved, "NORMALIZE", "frame_number"))
    tracked = sequence_integrity(
        fine.filter(F.col("kind") != UNSUPPORTED).select(FILE, "frame_number", "sequence"),
        source=FILE, order="frame_number")
    events = events.withColumnRenamed("frame_number", "position")
    return Inputs(events.withColumn("source_text", F.lit(None).cast("string")), failures, tracked)


def process_events(events: DataFrame, rules: dict | list | None = None,
                   blueprint: dict | None = None) -> DataFrame:
    """Transform and shape events; adds ``state``, ``stage``, ``detail`` and ``below`` (location).

    Narrow work only: one projection over the input, batch or streaming.
    """
    out = events
    stage, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    below = F.lit("")
    state = F.lit("EMITTED")
    if rules is not None:
        out = apply_transformation(out, rules)
        failed = F.col(STATUS) == FAILED
        stage, detail = F.when(failed, "TRANSFORM"), F.when(failed, F.col(f"{FAILURE}.detail"))
        state = F.when(failed, "FAILED").when(F.col(STATUS) == FILTERED, "FILTERED")
    if blueprint is not None:
        out = render_blueprint(out, blueprint)
        broken = F.col(BLUEPRINT_FAILURE).isNotNull()
        if rules is not None:
            broken = broken & ~F.col(STATUS).isin(FAILED, FILTERED)
        stage = F.coalesce(stage, F.when(broken, "BLUEPRINT"))
        detail = F.coalesce(detail, F.when(broken, F.col(f"{BLUEPRINT_FAILURE}.detail")))
        below = F.when(broken, F.col(f"{BLUEPRINT_FAILURE}.path")).otherwise("")
        state = (state if rules is not None else F).when(broken, "FAILED")
    if rules is not None or blueprint is not None:
        state = state.otherwise("EMITTED")
    return out.withColumns({"state": state, "stage": stage, "detail": detail, "below": below})


def parsed_states(parsed: DataFrame, rules: dict | list | None = None, blueprint: dict | None = None) -> DataFrame:
    """``process_events`` over rows of which some have an ``_issue``: those end as PARSE_FAILED."""
    out = process_events(parsed, rules, blueprint)
    bad = F.col("_issue").isNotNull()
    return out.withColumns({
        "state": F.when(bad, "PARSE_FAILED").otherwise(F.col("state")),
        "stage": F.when(bad, "PARSE").otherwise(F.col("stage")),
        "detail": F.when(bad, F.concat(F.col("_issue.reason"), F.lit(": "), F.col("_issue.detail")))
        .otherwise(F.col("detail")),
        "below": F.when(bad, F.lit("")).otherwise(F.col("below")),
    })


BAD = ("PARSE_FAILED", "NORMALIZE_FAILED", "FAILED")
STATE_PLACE = [FILE, BLOCK, ROW, "source_location", "below", "stage", "detail", "event", "source_text", "frame"]


def classified(inputs: Inputs, rules: dict | list | None = None, blueprint: dict | None = None,
               csv: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every row of the input with its state, place, failure and, if it goes on, its output in ``written``.

    ``written`` is the JSON line, or an array of CSV cells.  Only failed rows keep their source.
    """
    null, failed = F.lit(None), F.col("state").isin(*BAD)

    def shaped(df: DataFrame) -> DataFrame:
        written = record_line(df) if csv is None else F.array(*csv_columns(df, csv))
        return df.withColumns({
            "written": F.when(F.col("state") == "EMITTED", written), "source_text": F.when(failed, F.col("source_text")),
            "frame": null.cast("binary"), "event": F.when(F.col("stage") != "PARSE", F.col("metadata.eventId")),
        }).select(*STATE_PLACE, "state", "written")

    if inputs.parsed is not None:
        rows = normalized(inputs.parsed).withColumn("source_location", F.lit(None).cast("string"))
        return shaped(parsed_states(rows, rules, blueprint))
    zero = F.lit(0).cast("bigint")
    good = shaped(process_events(inputs.events, rules, blueprint).withColumns({BLOCK: zero, ROW: F.col("position").cast("bigint")}))
    bad = inputs.failures.withColumns({
        BLOCK: zero, ROW: F.col("position").cast("bigint"), "below": F.lit(""), "event": null.cast("string"),
        "state": F.concat(F.col("stage"), F.lit("_FAILED")), "written": null.cast(good.schema["written"].dataType)})
    return good.unionByName(bad.select(*STATE_PLACE, "state", "written"))


def first_failures(rows: DataFrame) -> DataFrame:
    """(file, block, scan position) of the first failed row of each file.

    Numbers alone are aggregated, by file and block, so no failed row is sorted or moved for it.
    """
    blocks = rows.filter(F.col("state").isin(*BAD)).groupBy(FILE, BLOCK).agg(F.min(ROW).alias(ROW))
    return (blocks.withColumn("__least", F.min(BLOCK).over(Window.partitionBy(FILE)))
            .filter(F.col(BLOCK) == F.col("__least")).drop("__least"))


def located_failures(rows: DataFrame, stop: bool = False, unit: str | None = None, blocks: int | None = None) -> DataFrame:
    """Failed rows of a written ``classified`` table with their positions and locations.

    ``stop`` keeps the first of each file.  With a ``unit``, positions are line numbers, composed from one small
    summary per block; that reads three narrow columns of the whole table.  ``blocks`` is a bound of their number, if known.
    """
    bad = rows.filter(F.col("state").isin(*BAD))
    if stop:
        # One row per file, whose paths the driver lists anyway, so failed rows stay where they are.
        bad = matched(bad, first_failures(rows), [FILE, BLOCK, ROW], "left_semi")
        others = F.struct(*[c for c in bad.columns if c != FILE]).alias("row")
        bad = bad.groupBy(FILE).agg(F.min_by(others, F.struct(BLOCK, ROW)).alias("row")).select(FILE, "row.*")
    bad = bad.withColumn("position", F.col(ROW))
    if unit is not None:
        offsets = line_offsets(rows.select(FILE, BLOCK, ROW))
        bad = bad.join(offsets if blocks is None else maybe_broadcast(offsets, blocks), [FILE, BLOCK]) \
            .withColumn("position", F.col(ROW) + F.col("__offset")) \
            .withColumn("source_location", F.concat(FILE, F.lit(f":{unit} "), F.col("position").cast("string")))
    return bad.select(FILE, "position", F.concat("source_location", F.coalesce("below", F.lit(""))).alias("source_location"),
                      "stage", "detail", "source_text", "frame", "event")


def counted(rows: DataFrame, stop: bool = False) -> dict[str, int]:
    """The six counters of a written ``classified`` table; with ``stop``, of each file up to its first failure."""
    if stop:
        first = first_failures(rows).select(FILE, F.struct(BLOCK, ROW).alias("__stop"))
        rows = rows.select(FILE, BLOCK, ROW, "state").join(F.broadcast(first), FILE, "left").filter(
            F.col("__stop").isNull() | (F.struct(BLOCK, ROW) <= F.col("__stop")))
    return run_counters(rows.select("state")).first().asDict()


SINK_ERRORS = (Py4JError, PySparkException, OSError)


def sink_failure(spark: SparkSession, place: str, error: Exception) -> Row:
    """A failure of the OUTPUT stage in the shape of other failures; the detail is one redacted line."""
    text = str(error).strip().split("\n", 1)[0] or type(error).__name__
    detail = spark.range(1).select(redact_message(F.lit(text))).first()[0]
    return Row(file_path=None, position=None, stage="OUTPUT", source_location=place, detail=detail)


def run(inputs: Inputs, output: str, rules: dict | list | None = None, blueprint: dict | None = None,
        csv: list[tuple[str, str]] | None = None, header: bool = True,
        dead_letter_path: str | None = None, config: DeadLetterConfig | None = None,
        pipeline_id: str = "local", pipeline_version: str = "1", sample: int = 100,
        kind: Kind = renamed, work: str | None = None) -> Report:
    """Run a pipeline and publish its output.

    Failed rows are counted and go on or are quarantined; with policy FAIL_FAST the run counts up to the
    first failure of a file, ends FAILED and publishes nothing.  An output or dead-letter folder that cannot be written
    is a failure of stage OUTPUT: the run ends FAILED and an older output stays as it was.  A failed output is quarantined
    as RETRYABLE.  Output becomes current only after the dead letters have.

    ``work`` is a folder that all executors share, for the classified rows; it is removed at the end.
    """
    rows = classified(inputs, rules, blueprint, csv)
    spark = rows.sparkSession
    work = work or scratch(spark, "run")
    try:
        rows.write.partitionBy("state").parquet(work)
        states = spark.read.schema(rows.schema).parquet(work)
        return _finish(states, inputs, output, csv, header, dead_letter_path, config, pipeline_id, pipeline_version, sample, kind)
    finally:
        remove(spark, work)


def _finish(states: DataFrame, inputs: Inputs, output: str, csv: list[tuple[str, str]] | None, header: bool,
            dead_letter_path: str | None, config: DeadLetterConfig | None, pipeline_id: str, pipeline_version: str,
            sample: int, kind: Kind) -> Report:
    spark = states.sparkSession
    stop = config is not None and config.policy == FAIL_FAST
    numbers = counted(states, stop)
    lines = inputs.parsed is not None
    failures = located_failures(states, stop, "line" if lines else None, block_bound(inputs.parsed) if lines else None)
    broken: list[Row] = []
    if not (stop and numbers["failed"]):
        good = states.filter(F.col("state") == "EMITTED")
        staged = kind(spark, output)
        try:
            if csv is None:
                good.select(F.col("written").alias("value")).write.text(staged.folder)
            else:
                csv_text(good.select(*[F.get("written", F.lit(i)).alias(name) for i, (name, _) in enumerate(csv)]), staged.folder, header)
        except SINK_ERRORS as error:
            staged.abort()
            broken.append(sink_failure(spark, "output", error))
        if config is not None and config.policy not in (SKIP, FAIL_FAST) and dead_letter_path:
            try:
                write_dead_letters(_letters(failures, broken, inputs, config, pipeline_id, pipeline_version), dead_letter_path, kind)
            except SINK_ERRORS as error:
                if not broken:
                    staged.abort()
                broken.append(sink_failure(spark, "dead-letter", error))
        if not broken:
            try:
                staged.commit()
            except SINK_ERRORS as error:
                staged.abort()
                broken.append(sink_failure(spark, "output", error))
    gaps = duplicates = 0
    if inputs.sequence is not None:
        total = sequence_counters(inputs.sequence, FILE).agg(
            F.coalesce(F.sum("sequence_gap_count"), F.lit(0)), F.coalesce(F.sum("duplicate_count"), F.lit(0))).first()
        gaps, duplicates = int(total[0]), int(total[1])
    first = []
    if numbers["failed"]:
        first = failures.select(FILE, "position", "stage", "source_location", "detail").orderBy(FILE, "position").limit(sample).collect()
    numbers["failed"] += len(broken)
    first = (first + broken)[:sample]
    return Report({name: numbers[name] for name in COUNTERS}, "FAILED" if broken or stop and numbers["failed"] else "COMPLETED",
                  first, numbers["failed"] - len(first), gaps, duplicates)


def _letters(failures: DataFrame, broken: list[Row], inputs: Inputs, config: DeadLetterConfig,
             pipeline_id: str, pipeline_version: str) -> DataFrame:
    """Dead letters of failed rows and of a failed output; frames are the payload of binary input, lines of text input."""
    if broken:
        lost = failures.sparkSession.createDataFrame(
            [(r.source_location, r.stage, r.detail) for r in broken], "source_location string, stage string, detail string")
        failures = failures.unionByName(lost, allowMissingColumns=True)
    source = {"source_text": F.col("source_text")} if inputs.sequence is None else {"frame": F.col("frame")}
    return quarantine([dead_letters(failures, F.col("stage"), F.col("source_location"), F.col("detail"), pipeline_id,
                                    pipeline_version, F.col("event"), config=config, **source)])
