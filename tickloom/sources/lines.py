"""Line numbers for text files, without a shuffle of the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BROADCAST_BLOCKS = 100_000

FILE, BLOCK, ROW = "file_path", "__block", "__row"


def read_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Lines with the file, block start and scan position they came from.

    ``value`` keeps blank lines.  Files split into blocks as usual.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW))


def block_bound(df: DataFrame) -> int:
    """Upper bound of the blocks of a scan: partitions hold whole blocks, files end one each."""
    return 2 * df.rdd.getNumPartitions() + len(df.inputFiles())


def maybe_broadcast(small: DataFrame, bound: int) -> DataFrame:
    """Broadcast hint only below a checked bound; above it Spark joins by shuffle."""
    return F.broadcast(small) if bound <= BROADCAST_BLOCKS else small


def with_ordinal(df: DataFrame, per_file: bool = True, name: str = "line_number") -> DataFrame:
    """Add the 1-based line number in the file (or over all files in path order).

    ``df`` comes from ``read_lines``.  Scan positions of one block are consecutive, so a number is
    position - first position of the block + lines in earlier blocks; only that one row per
    block is aggregated and joined back.
    """
    blocks = df.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("first"), F.count("*").alias("lines"))
    before = Window.orderBy(FILE, BLOCK)
    if per_file:
        before = Window.partitionBy(FILE).orderBy(BLOCK)
    offsets = blocks.select(
        FILE, BLOCK,
        (F.coalesce(F.sum("lines").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.col("first") + 1).alias("__offset"))
    offsets = maybe_broadcast(offsets, block_bound(df))
    return (df.join(offsets, [FILE, BLOCK])
            .withColumn(name, F.col(ROW) + F.col("__offset")).drop("__offset"))


def line_offsets(df: DataFrame) -> DataFrame:
    """Per file and block: what to add to a scan position to get the 1-based line number in the file.

    ``df`` holds every line of its files, as read or as written since.
    """
    blocks = df.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(FILE, BLOCK, (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("__offset"))


def until_first_error(df: DataFrame, errors: DataFrame, number: str = "line_number") -> DataFrame:
    """Rows of each file up to and including its first error."""
    first = errors.groupBy(FILE).agg(F.min(number).alias("__first"))
    first = maybe_broadcast(first, len(df.inputFiles()))
    return (df.join(first, FILE, "left")
            .filter(F.col("__first").isNull() | (F.col(number) <= F.col("__first"))).drop("__first"))


def read_summary(events: DataFrame, errors: DataFrame) -> DataFrame:
    """Per file: rows read, events produced, errors reported."""
    both = events.select(FILE, F.lit(1).alias("ok"), F.lit(1).alias("row")).unionByName(
        errors.select(FILE, F.lit(0).alias("ok"), F.col("counted").cast("int").alias("row")
                      if "counted" in errors.columns else F.lit(1).alias("row")))
    return both.groupBy(FILE).agg(
        F.sum("row").alias("rows_read"), F.sum("ok").alias("events_produced"),
        F.count_if(F.col("ok") == 0).alias("errors_reported"))
