"""Capture files of length-prefixed frames.

Where a frame starts is known only from the frames before it, so one file is one task; files run in
parallel.  Frames leave the task in batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.sources.frames import BAD_LENGTH, TOO_LARGE, TRUNCATED
from tickloom.sources.lines import FILE

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_SCHEMA = f"{FILE} string, frame_number long, frame binary, reason string, detail string"
MAX_FRAME = 65537
BATCH_FRAMES = 20_000


def _split(content: memoryview, max_frame: int) -> Iterator[tuple[bytes | None, str | None, str | None]]:
    """(frame, reason, detail) in file order; a bad length is reported and skipped."""
    at, end = 0, len(content)
    while at < end:
        if end - at < 2:
            yield None, TRUNCATED, f"STP frame requires 2 bytes but only {end - at} are available"
            return
        length = (content[at] << 8) | content[at + 1]
        size = length + 2
        if length < 1:
            yield None, BAD_LENGTH, f"encoded length must be between 1 and 65535: {length}"
        elif size > max_frame:
            yield None, TOO_LARGE, f"STP frame declares {size} bytes but configured maximum is {max_frame}"
        if at + size > end:
            yield None, TRUNCATED, f"STP frame requires {size} bytes but only {end - at} are available"
            return
        if 1 <= length and size <= max_frame:
            yield bytes(content[at:at + size]), None, None
        at += size


def split_capture(spark: SparkSession, path: str | list[str], max_frame: int = MAX_FRAME) -> DataFrame:
    """One row per frame or framing error of every capture file.

    ``frame_number`` counts both, from 1 per file.  ``frame`` is NULL for errors; good frames go on to
    ``decode_frames``.
    """
    if not 3 <= max_frame <= MAX_FRAME:
        raise ValueError(f"max_frame must be between 3 and {MAX_FRAME}")
    paths = [path] if isinstance(path, str) else path
    files = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias(FILE), "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                frames = _split(memoryview(content.as_buffer()), max_frame)
                start = 1
                while rows := list(islice(frames, BATCH_FRAMES)):
                    yield _batch(name.as_py(), start, rows)
                    start += len(rows)

    return files.mapInArrow(split, FRAME_SCHEMA)


def _batch(name: str, start: int, rows: list[tuple]) -> pa.RecordBatch:
    frame, reason, detail = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows), pa.string()), pa.array(range(start, start + len(rows)), pa.int64()),
         pa.array(frame, pa.binary()), pa.array(reason, pa.string()), pa.array(detail, pa.string())],
        names=[FILE, "frame_number", "frame", "reason", "detail"])


def split_errors(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, framing errors)."""
    return (split.filter(F.col("reason").isNull()).drop("reason", "detail"),
            split.filter(F.col("reason").isNotNull()))
