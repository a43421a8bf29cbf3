"""Stateful operators on streams; results equal the batch operators' when rows arrive in order.

Arrival order inside a micro-batch comes from a column, so rows are sorted in the state function.  A
key's rows of one micro-batch meet in one task; the trigger's batch size bounds them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.operators.orders import ADD, CANCEL, EXECUTE
from tickloom.operators.sequence import DUPLICATE, EXPECTED, GAP, LATE
from tickloom.schema import MAX_LONG

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _longs(values: list, present: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.asarray(values, dtype="int64"), ~present)


def sequence_integrity_stream(df: DataFrame, source: str = "source", sequence: str = "sequence",
                              order: str | list[str] = "arrival", buckets: int = 1024) -> DataFrame:
    """``sequence_integrity`` on a stream; the state of a source is its last accepted number.

    Sources may be many with few rows each, so state is kept per bucket of sources (source, last number): one call handles many.
    More ``buckets`` make smaller states; the number must stay the same for a checkpoint's life.
    """
    order = [order] if isinstance(order, str) else list(order)
    schema = T.StructType(df.schema.fields + [
        T.StructField("status", T.StringType()), T.StructField("expected", T.LongType()),
        T.StructField("missing", T.LongType())])
    names = df.columns

    def track(key, chunks, state):
        parts = list(chunks)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        group, found = pd.factorize(rows[source], use_na_sentinel=False)
        found = [None if pd.isna(s) else s for s in found.tolist()]
        held = dict(zip(*state.get)) if state.exists else {}
        # Numbers are positive, so 0 stands for "nothing accepted yet" and makes 1 the expected one.
        # One row per source stands for the state before the batch and comes before its rows.
        starts = np.array([held.get(s, 0) for s in found], dtype="int64")
        groups = np.concatenate((np.arange(len(found)), group))
        real = np.concatenate((np.zeros(len(found), bool), np.ones(len(rows), bool)))
        keys = [np.concatenate((np.repeat(v[:1], len(found)), v)) for v in (rows[c].to_numpy() for c in reversed(order))]
        at = np.lexsort((*keys, real, groups))
        values = np.concatenate((starts, rows[sequence].to_numpy(dtype="int64")))[at]
        top = pd.Series(values).groupby(groups[at]).cummax().to_numpy()
        spot = np.flatnonzero(real[at])
        numbers, last = values[spot], top[spot - 1]
        done = last == MAX_LONG
        expected = np.where(done, 0, last + np.where(done, 0, 1))
        status = np.select(
            [done & (numbers == last), done, numbers == expected, numbers > expected, numbers == last],
            [DUPLICATE, LATE, EXPECTED, GAP, DUPLICATE], LATE)
        missing = np.where(~done & (numbers > expected), numbers - expected, 0)
        ends = np.append(np.flatnonzero(np.diff(groups[at])), len(at) - 1)
        held.update(zip(found, top[ends].tolist()))
        state.update((list(held), list(held.values())))
        out = rows[names].iloc[at[spot] - len(found)].reset_index(drop=True)
        yield out.assign(status=status, expected=_longs(expected, ~done), missing=missing)

    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(source), F.lit(buckets)))
    kind = df.schema[source].dataType.simpleString()
    return bucketed.groupBy("__bucket").applyInPandasWithState(
        track, schema, f"sources array<{kind}>, last array<bigint>", "append", GroupStateTimeout.NoTimeout)


def order_state_stream(df: DataFrame, source: str = "source", order_id: str = "order_id",
                       kind: str = "kind", quantity: str = "quantity", symbol: str = "symbol",
                       order: str | list[str] = "arrival", buckets: int = 1024) -> DataFrame:
    """``order_state`` on a stream.

    Most orders have a few rows, so state is kept per (source, bucket of order ids) as the bucket's
    open orders (id, symbol, remainder): one call handles many orders.  A closed order leaves the state.
    More ``buckets`` make smaller states; the number must stay the same for a checkpoint's life.
    """
    order = [order] if isinstance(order, str) else list(order)
    schema = T.StructType(df.schema.fields + [
        T.StructField("remaining", T.LongType()), T.StructField("open_symbol", T.StringType())])
    names = df.columns

    def follow(key, chunks, state):
        parts = list(chunks)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        ids, group = np.unique(rows[order_id].to_numpy(dtype="int64"), return_inverse=True)
        old_ids, old_symbols, old_left = ((np.asarray(state.get[0], dtype="int64"),
                                           np.asarray(state.get[1], dtype=object),
                                           np.asarray(state.get[2], dtype="int64")) if state.exists else
                                          (np.empty(0, "int64"), np.empty(0, object), np.empty(0, "int64")))
        slot = pd.Index(old_ids).get_indexer(ids)
        known = slot >= 0
        # One row per order stands for the state before the batch and acts as its first Add.
        first_size, first_symbol = np.zeros(len(ids), "int64"), np.full(len(ids), None, dtype=object)
        first_size[known], first_symbol[known] = old_left[slot[known]], old_symbols[slot[known]]
        groups = np.concatenate((np.arange(len(ids)), group))
        real = np.concatenate((np.zeros(len(ids), bool), np.ones(len(rows), bool)))
        keys = [np.concatenate((np.repeat(v[:1], len(ids)), v)) for v in
                (rows[c].to_numpy() for c in reversed(order))]
        at = np.lexsort((*keys, real, groups))
        is_add = np.concatenate((np.ones(len(ids), bool), (rows[kind] == ADD).to_numpy()))[at]
        amount = rows[quantity].fillna(0).to_numpy(dtype="int64")
        less = np.concatenate((np.zeros(len(ids), "int64"),
                               np.where(rows[kind].isin([EXECUTE, CANCEL]), amount, 0)))[at]
        sizes = np.concatenate((first_size, amount))[at]
        symbols = np.concatenate((first_symbol, rows[symbol].to_numpy(dtype=object)))[at]
        taken = np.cumsum(less)
        adds = np.maximum.accumulate(np.where(is_add, np.arange(len(at)), 0))
        left = sizes[adds] - (taken - taken[adds])
        spot = np.flatnonzero(real[at])
        before, owner = left[spot - 1], symbols[adds[spot - 1]]
        is_open = before > 0
        # What stays open: the last row of each order, and old orders this batch did not touch.
        last = np.append(np.flatnonzero(np.diff(groups[at])), len(at) - 1)
        stays = left[last] > 0
        rest = np.ones(len(old_ids), bool)
        rest[slot[known]] = False
        new = (np.concatenate((old_ids[rest], ids[stays])),
               np.concatenate((old_symbols[rest], symbols[adds[last]][stays])),
               np.concatenate((old_left[rest], left[last][stays])))
        if len(new[0]):
            state.update(tuple(part.tolist() for part in new))
        elif state.exists:
            state.remove()
        out = rows[names].iloc[at[spot] - len(ids)].reset_index(drop=True)
        yield out.assign(remaining=_longs(before, is_open), open_symbol=np.where(is_open, owner, None))

    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(order_id), F.lit(buckets)))
    return bucketed.groupBy(source, "__bucket").applyInPandasWithState(
        follow, schema, "ids array<bigint>, symbols array<string>, remaining array<bigint>", "append",
        GroupStateTimeout.NoTimeout)
