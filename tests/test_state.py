import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import MAX
from tickloom.operators.orders import order_state, resolve_instruments
from tickloom.operators.scan import _PARTS, _PLACE, Running, composed, located
from tickloom.operators.sequence import sequence_integrity, sequence_strict
from tickloom.streaming.state import order_state_stream, sequence_integrity_stream

E, G, D, L = "EXPECTED", "GAP_DETECTED", "DUPLICATE", "LATE_OR_OUT_OF_ORDER"


def track(numbers):
    """The rule text as a loop over one source."""
    last, out = None, []
    for n in numbers:
        if last == MAX:
            out.append((D if n == last else L, None, 0))
            continue
        want = 1 if last is None else last + 1
        if n >= want:
            out.append((E if n == want else G, want, n - want))
            last = n
        else:
            out.append((D if n == last else L, want, 0))
    return out


def sequence_rows(seed=5, sources=("a", "b", "hot")):
    rng, rows, arrival = random.Random(seed), [], 0
    for _ in range(600):
        source = rng.choice([*sources, "hot", "hot"])
        arrival += rng.choice([1, 1, 1, 50])
        rows.append((source, arrival, max(1, arrival // 3 + rng.randint(-4, 4))))
    return rows


def by_source(rows):
    out = {}
    for source, arrival, n in sorted(rows, key=lambda r: r[1]):
        out.setdefault(source, []).append((arrival, n))
    return out


def expected_integrity(rows):
    return sorted((s, a, n, *r) for s, items in by_source(rows).items()
                  for (a, n), r in zip(items, track([n for _, n in items])))


def got_integrity(df):
    return sorted(tuple(r) for r in df.select("source", "arrival", "sequence", "status", "expected", "missing").collect())


def test_integrity_rules(spark):
    numbers = [1, 2, 5, 5, 3, 6, MAX, MAX, 7]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(numbers)], "source string, arrival long, sequence long")
    rows = sequence_integrity(df).orderBy("arrival").collect()
    assert [r["status"] for r in rows] == [E, E, G, D, L, E, G, D, L]
    assert [(r["expected"], r["missing"]) for r in rows][2] == (3, 2) and rows[-1]["expected"] is None
    first = spark.createDataFrame([("s", 0, 4)], df.schema)
    assert sequence_integrity(first).first()["missing"] == 3


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_hot_source_gives_the_same_result(spark, parts):
    rows = sequence_rows()
    df = spark.createDataFrame(rows, "source string, arrival long, sequence long").repartition(5)
    out = sequence_integrity(df, parts=parts)
    assert got_integrity(out) == expected_integrity(rows)


@pytest.mark.parametrize("first", ["if(id = 39998, 1000000000000, id)", "cast(id % 2 as bigint)"])
def test_hot_keys_split_evenly_and_without_a_job(spark, tmp_path, first):
    """Outliers and ties on the first order column alike."""
    rows = spark.range(40_000).selectExpr("if(id % 4 = 3, concat('k', id % 1000), 'hot') as source", f"{first} as arrival",
                                          "id as line", "id + 1 as sequence")
    rows = rows.union(spark.sql("select cast(null as string), 5L, 6L, 7L"))
    spark.sparkContext.setJobGroup(f"build {first}", "building a plan")
    spans = composed(rows, ["source"], ["arrival", "line"], [Running("n", "sum", F.lit(1))], [], 50)
    sequence_integrity(rows, order=["arrival", "line"], parts=50)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {first}")
    spans.write.parquet(str(tmp_path / "spans"))
    spans = spark.read.parquet(str(tmp_path / "spans"))  # the ranges are drawn anew by every run of the plan
    split = located(rows, spans, ["source"], ["arrival", "line"])
    sizes = {(r["source"], r[_PLACE]): r["count"] for r in split.groupBy("source", _PLACE).count().collect()}
    hot = [n for (source, place), n in sizes.items() if source == "hot"]
    assert sum(sizes.values()) == 40_001 and sum(hot) == 30_000 and len(hot) >= 45 and max(hot) < 2 * 30_000 / 45
    keys = spans.select("source", F.size(_PARTS).alias("n"), F.col(_PARTS)["p_n"].alias("begun")).collect()
    assert sum(r["n"] for r in keys) <= 2 * 50
    mine = next(r for r in keys if r["source"] == "hot")
    ends = [sum(sizes["hot", i] for i in range(k)) for k in range(1, mine["n"])]
    assert mine["begun"] == [None, *ends]


def test_scans_and_exchanges_do_not_multiply(spark, tmp_path):
    """One scan of the keys, one of the largest keys' narrow rows, one of all rows; one exchange of all rows, no join of rows."""
    path = str(tmp_path / "rows")
    spark.createDataFrame(order_rows(), ORDER_SCHEMA).selectExpr("*", "arrival as sequence", "arrival % 9 = 0 as forget").write.parquet(path)
    df = spark.read.parquet(path)
    for out in (sequence_integrity(df), sequence_integrity(df, reset="forget"), sequence_strict(df), order_state(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 3 and "SortMergeJoin" not in plan
        assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 5
        assert "ReadSchema: struct<source:string>" in plan or "ReadSchema: struct<source:string,order_id:bigint>" in plan


@pytest.mark.parametrize("parts", [None, 2, 25])
def test_reset_judges_against_one_again(spark, parts):
    rows = sequence_rows(9)
    df = spark.createDataFrame(rows, "source string, arrival long, sequence long") \
        .withColumn("forget", F.col("arrival") % 17 == 0)
    got = got_integrity(sequence_integrity(df, reset="forget", parts=parts))
    want = []
    for s, items in by_source(rows).items():
        runs = [[]]
        for a, n in items:
            if a % 17 == 0:
                runs.append([])
            runs[-1].append((a, n))
        for run in runs:
            want += [(s, a, n, *r) for (a, n), r in zip(run, track([n for _, n in run]))]
    assert got == sorted(want)


def test_strict(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([7, 9, 9, 8, 10])], "source string, arrival long, sequence long")
    assert [r["accepted"] for r in sequence_strict(df).orderBy("arrival").collect()] == [True, True, False, False, True]


ORDER_SCHEMA = "source string, order_id long, arrival long, kind string, quantity long, symbol string"


def order_rows(seed=11):
    rng, rows = random.Random(seed), []
    for arrival in range(900):
        order = rng.choice([1, 1, 1, 2, 3, 4, 5, 6])
        kind = rng.choice(["ORDER_ADDED", "ORDER_EXECUTED", "ORDER_EXECUTED", "ORDER_CANCELLED", "TRADE"])
        rows.append((rng.choice("xy"), order, arrival, kind, rng.randint(1, 60) + (60 if kind == "ORDER_ADDED" else 0),
                     f"S{arrival}" if kind in ("ORDER_ADDED", "TRADE") else None))
    return rows


def follow(rows):
    """The rule text as a loop: state before each row."""
    open_orders, out = {}, []
    for row in sorted(rows, key=lambda r: r[2]):
        source, order, _, kind, quantity, symbol = row
        key = (source, order)
        state = open_orders.get(key)
        out.append((*row, state[1] if state else None, state[0] if state else None))
        if kind == "ORDER_ADDED":
            open_orders[key] = (symbol, quantity)
        elif kind in ("ORDER_EXECUTED", "ORDER_CANCELLED") and state:
            left = state[1] - quantity
            if left <= 0:
                del open_orders[key]
            else:
                open_orders[key] = (state[0], left)
    return sorted(out, key=lambda r: r[2])


def got_orders(df):
    names = ["source", "order_id", "arrival", "kind", "quantity", "symbol", "remaining", "open_symbol"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: r[2])


@pytest.mark.parametrize("parts", [None, 3, 60])
def test_order_state(spark, parts):
    rows = order_rows()
    df = spark.createDataFrame(rows, ORDER_SCHEMA).repartition(5)
    assert got_orders(order_state(df, parts=parts)) == follow(rows)


def test_resolve(spark):
    rows = [("s", 1, 1, "ORDER_EXECUTED", 5, None), ("s", 1, 2, "ORDER_ADDED", 100, "ZORB"), ("s", 1, 3, "ORDER_CANCELLED", 40, None),
            ("s", 1, 4, "ORDER_EXECUTED", 90, None), ("s", 1, 5, "ORDER_EXECUTED", 1, None), ("s", 1, 6, "TRADE", 1, "QUIX")]
    out = resolve_instruments(spark.createDataFrame(rows, ORDER_SCHEMA)).orderBy("arrival").collect()
    assert [r["instrument"] for r in out] == [None, "ZORB", "ZORB", "ZORB", None, "QUIX"]
    assert [bool(r["resolve_error"]) for r in out] == [True, False, False, False, True, False]


def stream(spark, tmp_path, rows, schema, apply, batches=3):
    """Feed rows in arrival order as several micro-batches."""
    size = -(-len(rows) // batches)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for i in range(batches):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        apply(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")) \
            .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_sequence_stream_equals_batch(spark, tmp_path):
    rows = sorted(sequence_rows(21), key=lambda r: r[1]) + [("z", 10 ** 6, MAX), ("z", 10 ** 6 + 1, MAX), ("z", 10 ** 6 + 2, 3)]
    out = stream(spark, tmp_path, rows, "source string, arrival long, sequence long", sequence_integrity_stream)
    assert got_integrity(out) == expected_integrity(rows)


def test_sources_share_states(spark, tmp_path):
    """Many sources with few rows, one of them null, in fewer states than sources; each goes on where it was."""
    schema = "source string, arrival long, sequence long"
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "cp"))
    names = [None, *[f"s{i}" for i in range(49)]]
    for batch, number in enumerate((1, 2, 4)):
        rows = [(s, batch * 100 + i, number) for i, s in enumerate(names)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        apply = sequence_integrity_stream(spark.readStream.schema(schema).parquet(path), buckets=4)
        query = apply.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark) \
            .trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    got = spark.read.parquet(out).groupBy("source", "status").agg(F.sum("missing")).collect()
    assert {tuple(r) for r in got} == {(s, k, m) for s in names for k, m in (("EXPECTED", 0), ("GAP_DETECTED", 1))}


def test_order_stream_equals_batch(spark, tmp_path):
    rows = order_rows(22)
    out = stream(spark, tmp_path, rows, ORDER_SCHEMA, lambda s: order_state_stream(s, buckets=3))
    assert got_orders(out) == follow(rows)


def test_closed_orders_leave_the_state(spark, tmp_path):
    """Four micro-batches: orders open in the first, shrink in the next two and close in the last."""
    def batch(kind, quantity, at):
        return [("s", i, kind, quantity, f"Y{i}" if kind == "ORDER_ADDED" else None, at * 100 + i) for i in range(40)]

    schema = "source string, order_id long, kind string, quantity long, symbol string, arrival long"
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "cp"))
    held = []
    for rows in (batch("ORDER_ADDED", 9, 0), batch("ORDER_EXECUTED", 2, 1), batch("ORDER_CANCELLED", 3, 2), batch("ORDER_EXECUTED", 4, 3)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream_in = spark.readStream.schema(schema).parquet(path)
        query = order_state_stream(stream_in, buckets=4).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] == held[1] == held[2] == 4 and held[3] == 0
    left = {(r.arrival // 100, r.remaining) for r in spark.read.parquet(out).collect()}
    assert left == {(0, None), (1, 9), (2, 7), (3, 4)}
