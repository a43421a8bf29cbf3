"""Sequence integrity per source: expected, gap, duplicate, late.  Rows are classified, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.scan import Running, running
from tickloom.schema import MAX_LONG

EXPECTED = "EXPECTED"
GAP = "GAP_DETECTED"
DUPLICATE = "DUPLICATE"
LATE = "LATE_OR_OUT_OF_ORDER"

_LAST, _EPOCH = "__last_accepted", "__epoch"


def classify(sequence: Column, last: Column) -> tuple[Column, Column, Column]:
    """(status, expected, missing count) of a number, given the last accepted one or NULL.

    The first expected number is 1; after the largest long there is no next one.
    """
    sequence = sequence.cast("bigint")
    exhausted = last == MAX_LONG
    expected = (F.when(last.isNull(), F.lit(1).cast("bigint"))
                .when(~exhausted, last + F.lit(1)))
    status = (F.when(exhausted & (sequence == last), DUPLICATE)
              .when(exhausted, LATE)
              .when(sequence == expected, EXPECTED)
              .when(sequence > expected, GAP)
              .when(sequence == last, DUPLICATE)
              .otherwise(LATE))
    missing = F.when(~F.coalesce(exhausted, F.lit(False)) & (sequence > expected),
                     sequence - expected).otherwise(F.lit(0).cast("bigint"))
    return status, expected, missing


def sequence_integrity(df: DataFrame, source: str = "source", sequence: str = "sequence",
                       order: str | list[str] = "arrival", reset: str | None = None,
                       parts: int | None = None) -> DataFrame:
    """Add ``status``, ``expected`` and ``missing`` to every row.

    The last accepted number is the running maximum of the earlier rows, since only an expected
    number or a gap moves it and both lie above it.  ``reset`` names a boolean column; a marked row is
    judged against 1 again, as if its source had been forgotten before it.
    """
    order = [order] if isinstance(order, str) else list(order)
    number = F.col(sequence).cast("bigint")
    if reset is None:
        out = running(df, [source], order, [Running(_LAST, "max", number)], parts=parts)
        last = F.col(_LAST)
    else:
        # Epochs only grow, so the largest (epoch, number) is the largest number since the last reset.
        epoch = Running(_EPOCH, "sum", F.coalesce(F.col(reset), F.lit(False)).cast("bigint"), inclusive=True)
        top = Running(_LAST, "max", F.struct(F.col(_EPOCH).alias("epoch"), number.alias("number")),
                      lift=lambda s, sums: F.when(s.isNotNull(), F.struct((s["epoch"] + sums[_EPOCH]).alias("epoch"), s["number"].alias("number"))))
        out = running(df, [source], order, [epoch], [top], parts)
        last = F.when(F.col(_LAST)["epoch"] == F.col(_EPOCH), F.col(_LAST)["number"])
    status, expected, missing = classify(F.col(sequence), last)
    return out.withColumns({"status": status, "expected": expected, "missing": missing}).drop(_LAST, _EPOCH)


def sequence_strict(df: DataFrame, source: str = "source", sequence: str = "sequence",
                    order: str | list[str] = "arrival", parts: int | None = None) -> DataFrame:
    """Add ``accepted`` and ``previous``: a number not above the last accepted one is rejected.

    A source may start at any positive number and may skip numbers.
    """
    order = [order] if isinstance(order, str) else list(order)
    out = running(df, [source], order, [Running("previous", "max", F.col(sequence).cast("bigint"))], parts=parts)
    return out.withColumn("accepted", F.col("previous").isNull() | (F.col(sequence) > F.col("previous")))
