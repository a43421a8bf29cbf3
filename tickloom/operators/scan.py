"""Running aggregates over ordered rows of a key, as one composed prefix scan that no hot key can slow down.

A plain window sorts one key in one task.  A first pass counts keys; the largest ones, as many as there are parts, can be more
than a task's share, and no other key can.  Their rows, narrowed to key, order and values, are dealt by ranges of (key, order), so
that ties on the first order column spread too; one summary per (key, part) is composed over the parts of its key.  There are
at most two summaries per border, so they are broadcast.  The last pass finds each row's part among its key's borders,
runs plain windows per (key, part), and adds what the parts before it hold.  Aggregates that build on others (``then``) share the
passes.  No job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_PART, _PARTS, _PLACE = "__part", "__parts", "__place"


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is max, sum or last (last value that is not NULL).

    ``lift`` is for aggregates whose values build on sums: it makes the state of a part one of the whole key, given, by name,
    what the sums were where the part begins.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = False
    lift: Callable[[Column, dict[str, Column]], Column] | None = None


def _aggregate(kind: str, value: Column) -> Column:
    return {"max": F.max, "sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}[kind](value)


def _combined(kind: str, before: Column, own: Column) -> Column:
    if kind == "max":
        return F.when(before.isNull() | (own > before), own).otherwise(before)
    if kind == "last":
        return F.coalesce(own, before)
    return F.when(own.isNull() & before.isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))


def _over(item: Running, window) -> Column:
    end = Window.currentRow if item.inclusive else -1
    return _aggregate(item.kind, item.value).over(window.rowsBetween(Window.unboundedPreceding, end))


def composed(df: DataFrame, keys: list[str], order: list[str], items: list[Running], then: list[Running],
             parts: int | None = None) -> DataFrame:
    """(keys, parts): of the ``parts`` largest keys those that cross a border, with each part's last place and the
    aggregates where it begins.

    At most two entries per border, whatever the size of the input.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), *keys).limit(parts)
    ranged = matched(df, largest.drop("__n"), keys, "left_semi").repartitionByRange(parts, *keys, *order) \
        .withColumn(_PART, F.spark_partition_id())
    per_part = Window.partitionBy(*keys, _PART).orderBy(*order)
    if then:  # what they build on, as counted from the part's own beginning
        ranged = ranged.withColumns({i.name: _over(i, per_part) for i in items})
    place = F.struct(*order)
    states = []
    for item in items + then:
        if item.kind == "last":
            states.append(F.max_by(F.when(item.value.isNotNull(), item.value),
                                   F.when(item.value.isNotNull(), place)).alias(f"__s_{item.name}"))
        else:
            states.append(_aggregate(item.kind, item.value).alias(f"__s_{item.name}"))
    summaries = ranged.groupBy(*keys, _PART).agg(F.max(place).alias("__last"), *states)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    begun = summaries.withColumns({"__n": F.count(F.lit(1)).over(whole), **{
        f"__p_{i.name}": _aggregate(i.kind, F.col(f"__s_{i.name}")).over(before) for i in items}}).filter("__n > 1")
    sums = {i.name: F.coalesce(F.col(f"__p_{i.name}"), F.lit(0)) for i in items if i.kind == "sum"}
    lifted = begun.withColumns({f"__s_{i.name}": i.lift(F.col(f"__s_{i.name}"), sums) for i in then if i.lift})
    done = lifted.withColumns({f"__p_{i.name}": _aggregate(i.kind, F.col(f"__s_{i.name}")).over(before) for i in then})
    entry = F.struct(_PART, F.col("__last").alias("last"), *[F.col(f"__p_{i.name}").alias(f"p_{i.name}") for i in items + then])
    return done.groupBy(*keys).agg(F.array_sort(F.collect_list(entry), lambda a, b: a[_PART] - b[_PART]).alias(_PARTS))


def matched(df: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with a bounded number of keys, NULL among them; their key columns do not come along."""
    few = few.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(F.broadcast(few), same, how).drop(*[f"__k_{k}" for k in keys])


def located(df: DataFrame, spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with its key's parts, NULL where the key has one, and the number of its own among them."""
    joined = matched(df, spans.select(*keys, _PARTS), keys, "left")
    place = F.struct(*order)
    # The first part whose last place is not before the row: a binary search over the key's own borders.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(20))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step < F.size(_PARTS)) & (F.get(F.col(_PARTS), low + step - 1)["last"] < place), low + step).otherwise(low))
    return joined.withColumn(_PLACE, F.when(F.col(_PARTS).isNotNull(), found))


def running(df: DataFrame, keys: list[str], order: list[str], items: list[Running], then: list[Running] | None = None,
            parts: int | None = None) -> DataFrame:
    """Add each running aggregate over the earlier rows of the key (own row included on request).

    ``order`` must order the rows of a key totally.  ``then`` names aggregates whose values use the ``items``.
    ``parts`` is the number of ranges and of keys that may be cut, by default the session's shuffle partitions, at most 2^20.
    """
    then = then or []
    out = located(df, composed(df, keys, order, items, then, parts), keys, order)
    window = Window.partitionBy(*keys, _PLACE).orderBy(*order)
    here = F.get(F.col(_PARTS), F.col(_PLACE))
    for stage in (items, then):
        if stage:
            out = out.withColumns({i.name: _over(i, window) for i in stage})
            out = out.withColumns({i.name: _combined(i.kind, here[f"p_{i.name}"], F.col(i.name)) for i in stage})
    return out.drop(_PARTS, _PLACE)
