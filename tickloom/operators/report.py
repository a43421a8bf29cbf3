"""Run counters, rates, samples and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.operators.sequence import DUPLICATE, GAP
from tickloom.schema import MAX_LONG

HISTORY = 120
RECENT_DEAD_LETTERS = 50
RETAINED_FAILURES = 100
COUNTERS = ("received", "parsed", "normalized", "filtered", "emitted", "failed")

# The furthest point a row reached, in order.
STATES = ("PARSE_FAILED", "NORMALIZE_FAILED", "FILTERED", "FAILED", "EMITTED")


def counter_columns(state: Column) -> dict[str, Column]:
    """Aggregates of the six counters over a column with the states above.

    received = emitted + filtered + failed, and parsed = normalized + normalize failures.
    """
    return {
        "received": F.count(F.lit(1)),
        "parsed": F.count_if(state != "PARSE_FAILED"),
        "normalized": F.count_if(~state.isin("PARSE_FAILED", "NORMALIZE_FAILED")),
        "filtered": F.count_if(state == "FILTERED"),
        "emitted": F.count_if(state == "EMITTED"),
        "failed": F.count_if(state.isin("PARSE_FAILED", "NORMALIZE_FAILED", "FAILED")),
    }


def run_counters(df: DataFrame, state: str = "state", by: list[str] | None = None) -> DataFrame:
    """One row of counters, or one per group: a single aggregation with map-side partials."""
    columns = [c.alias(n) for n, c in counter_columns(F.col(state)).items()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def observe_counters(df: DataFrame, name, state: str = "state") -> DataFrame:
    """Counters as observed metrics of whatever action reads ``df``; no job of their own."""
    return df.observe(name, *[c.alias(n) for n, c in counter_columns(F.col(state)).items()])


def sequence_counters(df: DataFrame, source: str = "source") -> DataFrame:
    """Per source: numbers missing in gaps and duplicates.  Late rows are not counted.

    The sum is a wide decimal, since gaps near the largest long add up beyond it.
    """
    return df.groupBy(source).agg(
        F.coalesce(F.sum(F.when(F.col("status") == GAP, F.col("missing").cast("decimal(20,0)"))),
                   F.lit(0)).cast("decimal(38,0)").alias("sequence_gap_count"),
        F.count_if(F.col("status") == DUPLICATE).alias("duplicate_count"))


def failure_sample(df: DataFrame, order: list[str], n: int = RETAINED_FAILURES) -> tuple[DataFrame, DataFrame]:
    """(first ``n`` failures in order, one row with how many more there are)."""
    return (df.orderBy(*order).limit(n),
            df.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("suppressed")))


def run_outcome(counters: DataFrame, policy: str | None = None, sink_failed: bool = False) -> DataFrame:
    """Add ``outcome``: FAILED for a sink error or a fail-fast policy that met a failure.

    Record failures alone do not fail a run.
    """
    if sink_failed:
        return counters.withColumn("outcome", F.lit("FAILED"))
    fail_fast = F.lit(policy == "FAIL_FAST")
    return counters.withColumn("outcome", F.when(fail_fast & (F.col("failed") > 0), "FAILED")
                               .otherwise("COMPLETED"))


def event_rate(samples: DataFrame, run: str | list[str] = "run", at: str = "timestamp_nanos",
               received: str = "received", last: int = HISTORY) -> DataFrame:
    """Events per second over each run's last samples, rounded down.

    0 with fewer than two samples, no elapsed time or a count that went down.
    """
    keys = [run] if isinstance(run, str) else list(run)
    recent = recent_per_key(samples, keys, [F.col(at).desc(), F.col(received).desc()], last)
    first = F.struct(at, received)
    spans = recent.groupBy(*keys).agg(F.count("*").alias("n"), F.min(first).alias("a"), F.max(first).alias("b"))
    elapsed = F.col(f"b.{at}") - F.col(f"a.{at}")
    gain = F.col(f"b.{received}") - F.col(f"a.{received}")
    rate = F.call_function("div", gain.cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"),
                           elapsed.cast("decimal(19,0)"))
    ok = (F.col("n") >= 2) & (elapsed > 0) & (gain >= 0)
    return spans.select(*keys, F.when(ok, F.least(rate, F.lit(MAX_LONG))).otherwise(F.lit(0)).cast("bigint")
                        .alias("events_per_second"))


def duration_average(df: DataFrame, duration: str, by: list[str] | None = None) -> DataFrame:
    """Average of a duration with integer division; 0 when there is none."""
    total, n = F.sum(F.col(duration)), F.count(duration)
    value = F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", total, n))
    return df.groupBy(*(by or [])).agg(value.alias("average"))


def recent_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key; Spark prunes to ``n`` per key before the shuffle as well."""
    return (df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("__rn") <= n).drop("__rn"))


def recent_dead_letters(letters: DataFrame, run: str = "pipelineId", n: int = RECENT_DEAD_LETTERS) -> DataFrame:
    """Newest dead letters of each run."""
    return recent_per_key(letters, [run], [F.col("timestamp").desc(), F.col("failureId")], n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the highest order value of each key; partial maxima are taken before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in others])


def in_source_order(df: DataFrame, source: str, ordinal: str) -> DataFrame:
    """Rows of a source together and in input order, for writing; hot sources split by range."""
    return df.repartitionByRange(source, ordinal).sortWithinPartitions(source, ordinal)
