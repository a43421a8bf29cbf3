"""Dead letters: failed rows as quarantine records with stable ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.ids import CANONICAL_SCHEMA_VERSION, PIPELINE_SCHEMA_VERSION, failure_id
from tickloom.functions.text import binary_payload, redact_message, redact_payload
from tickloom.schema import DEAD_LETTER_SCHEMA

QUARANTINE, SKIP, FAIL_FAST = "QUARANTINE", "SKIP", "FAIL_FAST"
POLICIES = (QUARANTINE, SKIP, FAIL_FAST)

# Category and retryability of every stage.
STAGES = {
    "PARSE": ("MALFORMED_INPUT", "NON_RETRYABLE"),
    "NORMALIZE": ("NORMALIZATION", "NON_RETRYABLE"),
    "TRANSFORM": ("TRANSFORMATION", "NON_RETRYABLE"),
    "BLUEPRINT": ("BLUEPRINT", "NON_RETRYABLE"),
    "OUTPUT": ("OUTPUT", "RETRYABLE"),
}
DEFAULT_MAX_BYTES = 4096


@dataclass(frozen=True)
class DeadLetterConfig:
    """What happens to failed rows, and whether their redacted source is kept."""

    policy: str = QUARANTINE
    include_payload: bool = False
    max_bytes: int = DEFAULT_MAX_BYTES

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"unknown dead-letter policy: {self.policy}")
        if self.max_bytes < 1:
            raise ValueError("max_bytes must be positive")


def classify_failure(stage: Column) -> tuple[Column, Column]:
    """(category, retryability) of a stage."""
    category = retry = None
    for name, (c, r) in STAGES.items():
        category = F.when(stage == name, c) if category is None else category.when(stage == name, c)
        retry = F.when(stage == name, r) if retry is None else retry.when(stage == name, r)
    return category, retry


def source_location(path: Column, unit: str, number: Column, below: Column | None = None) -> Column:
    """``<path>:line n``, ``:row n`` or ``:frame n``, followed by a blueprint location if given."""
    parts = [path, F.lit(f":{unit} "), number.cast("string")]
    return F.concat(*parts, F.coalesce(below, F.lit(""))) if below is not None else F.concat(*parts)


def dead_letters(df: DataFrame, stage: str | Column, location: Column, message: Column,
                 pipeline_id: str, pipeline_version: str, event: Column | None = None,
                 source_text: Column | None = None, frame: Column | None = None,
                 config: DeadLetterConfig | None = None, at: Column | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` as quarantine records.

    The payload of a bad binary frame is the frame itself.  ``at`` is the record's timestamp text;
    the default is the time of the run.
    """
    config = config or DeadLetterConfig()
    stage = F.lit(stage) if isinstance(stage, str) else stage
    event = F.lit(None).cast("string") if event is None else event
    category, retry = classify_failure(stage)
    payload_type = DEAD_LETTER_SCHEMA["payload"].dataType
    payload = F.lit(None).cast(payload_type)
    if config.include_payload and source_text is not None:
        payload = redact_payload(source_text, config.max_bytes)
    elif config.include_payload and frame is not None:
        payload = binary_payload(frame, config.max_bytes)
    if at is None:
        at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                           "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    staged = df.withColumns({
        "__stage": stage, "__location": location, "__event": event, "__message": redact_message(message)})
    c = F.col
    category, retry = classify_failure(c("__stage"))
    return staged.select(
        *(keep or []),
        failure_id(F.lit(pipeline_id), F.lit(pipeline_version), c("__stage"), c("__location"), c("__event"),
                   category, c("__message")).alias("failureId"),
        F.lit(pipeline_id).alias("pipelineId"), F.lit(pipeline_version).alias("pipelineVersion"),
        c("__stage").alias("stage"), c("__location").alias("sourceLocation"), c("__event").alias("eventId"),
        category.alias("category"), c("__message").alias("safeMessage"),
        payload.cast(payload_type).alias("payload"), at.alias("timestamp"), retry.alias("retryability"),
        F.lit(CANONICAL_SCHEMA_VERSION).alias("canonicalSchemaVersion"),
        F.lit(PIPELINE_SCHEMA_VERSION).alias("pipelineSchemaVersion"))


def quarantine(letters: list[DataFrame], policy: str = QUARANTINE) -> DataFrame:
    """Quarantine rows of all stages under a policy.

    QUARANTINE keeps them, SKIP keeps none (they still count as failed), FAIL_FAST makes the job that
    reads them fail on the first row, so nothing is published.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown dead-letter policy: {policy}")
    out = letters[0]
    for more in letters[1:]:
        out = out.unionByName(more)
    if policy == SKIP:
        return out.limit(0)
    if policy == FAIL_FAST:
        stop = F.raise_error(F.concat(F.lit("run stopped at "), F.col("sourceLocation"), F.lit(": "),
                                      F.col("safeMessage")))
        return out.withColumn("failureId", F.coalesce(stop.cast("string"), F.col("failureId")))
    return out
