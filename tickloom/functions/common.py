"""Helpers shared by the scalar functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def groups(text: Column, pattern: str, count: int) -> Column:
    """Struct g1..gN of a pattern's groups."""
    return F.struct(*[F.regexp_extract(text, pattern, n).alias(f"g{n}") for n in range(1, count + 1)])


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a computed column without computing it twice.

    Spark moves a filter below the projections it reads from, which would copy a whole rule list into
    the filter and evaluate it again.  An observed row count stops the move and costs next to nothing.
    """
    return df.observe(f"rows_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows")).filter(condition)
