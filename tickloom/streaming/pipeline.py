"""Stateless operators on streams, and good rows and dead letters from one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.common import keep
from tickloom.functions.jsontext import json_line
from tickloom.operators.deadletter import DeadLetterConfig, dead_letters
from tickloom.operators.report import counter_columns
from tickloom.plans.run import parsed_states
from tickloom.schema import DEAD_LETTER_SCHEMA
from tickloom.sinks.files import record_line
from tickloom.sources.jsonl import parse_event_lines
from tickloom.operators.validate import normalized

OBSERVED = "run_counters"


def read_event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Canonical JSON Lines as a stream of parsed rows; ``_issue`` is NULL for good ones.

    A stream has no line numbers; the location is the file.
    """
    lines = spark.readStream.options(**options).text(path).select(
        F.col("value").alias("source_text"), F.col("_metadata.file_path").alias("file_path"))
    parsed = parse_event_lines(lines, "source_text")
    return normalized(parsed).withColumn("source_location", F.col("file_path"))


def stream_states(parsed: DataFrame, rules: dict | list | None = None,
                  blueprint: dict | None = None) -> DataFrame:
    """Every parsed row with its final ``state``, ``stage``, ``detail`` and output columns."""
    return parsed_states(parsed, rules, blueprint)


def observed(states: DataFrame, name: str = OBSERVED) -> DataFrame:
    """Live counters as observed metrics: read them from the query's progress or a listener."""
    return states.observe(name, *[c.alias(n) for n, c in counter_columns(F.col("state")).items()])


def live_counters(query: StreamingQuery, name: str = OBSERVED) -> dict[str, int]:
    """Sum of the observed counters over the progress a query still holds; fails once it has dropped any.

    Spark holds a bounded number of progress reports.  ``start_counter_stream`` counts a query of any length.
    """
    total: dict[str, int] = {}
    reports = query.recentProgress
    if reports and reports[0]["batchId"] > 0:
        raise ValueError("the first reports of this query are gone; count with start_counter_stream")
    for progress in reports:
        row = progress["observedMetrics"].get(name)
        if row is None:
            continue
        for key, value in row.asDict().items():
            total[key] = total.get(key, 0) + value
    return total


def start_counter_stream(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the state of every row, one small column, to a sink that commits each batch exactly once."""
    return (states.select("state").writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_counters(spark: SparkSession, path: str) -> DataFrame:
    """The six counters over all committed batches of ``start_counter_stream``."""
    return spark.read.schema("state string").parquet(path).agg(
        *[c.alias(n) for n, c in counter_columns(F.col("state")).items()])


def good_lines(states: DataFrame) -> DataFrame:
    """JSON lines of emitted rows."""
    return keep(states, F.col("state") == "EMITTED").select(record_line(states).alias("value"))


def letters_of(states: DataFrame, pipeline_id: str, pipeline_version: str,
               config: DeadLetterConfig | None = None) -> DataFrame:
    """Dead letters of failed rows."""
    failed = keep(states, F.col("state").isin("PARSE_FAILED", "NORMALIZE_FAILED", "FAILED"))
    return dead_letters(failed, F.col("stage"), F.concat("source_location", "below"), F.col("detail"),
                        pipeline_id, pipeline_version, F.col("metadata.eventId"), F.col("source_text"),
                        config=config)


def batch_writer(good_path: str, letter_path: str, pipeline_id: str, pipeline_version: str,
                 config: DeadLetterConfig | None = None) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: good rows and dead letters of one micro-batch.

    Each batch owns a directory named by its id, so a repeated batch replaces its own files; dead
    letters are unique by failure id.
    """
    def write(states: DataFrame, batch_id: int) -> None:
        states.persist()
        try:
            good_lines(states).write.mode("overwrite").text(f"{good_path}/batch_id={batch_id}")
            letters = letters_of(states, pipeline_id, pipeline_version, config).dropDuplicates(["failureId"])
            letters.select(json_line(DEAD_LETTER_SCHEMA).alias("value")) \
                .write.mode("overwrite").text(f"{letter_path}/batch_id={batch_id}")
        finally:
            states.unpersist()

    return write


def start_file_streams(states: DataFrame, good_path: str, letter_path: str, checkpoint: str,
                       pipeline_id: str, pipeline_version: str,
                       config: DeadLetterConfig | None = None) -> list[StreamingQuery]:
    """The same as two queries on file sinks, which commit each batch exactly once."""
    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        return (df.writeStream.format("text").option("path", path)
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start())

    letters = letters_of(states, pipeline_id, pipeline_version, config)
    return [start(good_lines(observed(states)), good_path, "good"),
            start(letters.select(json_line(DEAD_LETTER_SCHEMA).alias("value")), letter_path, "letters")]
