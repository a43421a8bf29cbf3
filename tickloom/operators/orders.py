"""Open-order state: which instrument an Execute or Cancel belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.operators.scan import Running, running

ADD, EXECUTE, CANCEL, TRADE = "ORDER_ADDED", "ORDER_EXECUTED", "ORDER_CANCELLED", "TRADE"
NOT_RESOLVED = "INSTRUMENT_NOT_RESOLVED"


def order_state(df: DataFrame, source: str = "source", order_id: str = "order_id",
                kind: str = "kind", quantity: str = "quantity", symbol: str = "symbol",
                order: str | list[str] = "arrival", parts: int | None = None) -> DataFrame:
    """Add ``open_symbol`` and ``remaining``: the order's state just before each row.

    An Add opens or replaces the order; Execute and Cancel reduce it; at or below zero it is closed
    until the next Add.  Both are NULL when the order is not open.  State moves after the row itself,
    so an Execute larger than the remainder still finds the order.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = [source, order_id]
    is_add = F.col(kind) == ADD
    is_less = F.col(kind).isin(EXECUTE, CANCEL)
    taken = Running("__taken", "sum", F.when(is_less, F.col(quantity)).otherwise(F.lit(0)).cast("bigint"))
    so_far = F.coalesce(F.col("__taken"), F.lit(0).cast("bigint"))
    last_add = Running("__open", "last", F.when(is_add, F.struct(
        F.col(symbol).alias("symbol"), F.col(quantity).cast("bigint").alias("quantity"), so_far.alias("taken"))),
        lift=lambda s, sums: F.when(s.isNotNull(), s.withField("taken", s["taken"] + sums["__taken"])))
    out = running(df, keys, order, [taken], [last_add], parts).withColumn("__taken", so_far)
    remaining = F.col("__open.quantity") - (F.col("__taken") - F.col("__open.taken"))
    return (out.withColumn("remaining", F.when(remaining > 0, remaining))
            .withColumn("open_symbol", F.when(F.col("remaining").isNotNull(), F.col("__open.symbol")))
            .drop("__taken", "__open"))


def resolve_instruments(df: DataFrame, source: str = "source", order_id: str = "order_id",
                        kind: str = "kind", quantity: str = "quantity", symbol: str = "symbol",
                        order: str | list[str] = "arrival", parts: int | None = None) -> DataFrame:
    """Add ``instrument`` and ``resolve_error``.

    Add and Trade rows carry their own symbol; Execute and Cancel take it from the open order and get
    INSTRUMENT_NOT_RESOLVED when there is none.  Trades take no part in the order state.
    """
    order = [order] if isinstance(order, str) else list(order)
    needs = F.col(kind).isin(EXECUTE, CANCEL)
    orders = order_state(df.filter(F.col(kind).isin(ADD, EXECUTE, CANCEL)), source, order_id, kind,
                         quantity, symbol, order, parts)
    others = df.filter(~F.col(kind).isin(ADD, EXECUTE, CANCEL)) \
        .withColumns({"remaining": F.lit(None).cast("bigint"),
                      "open_symbol": F.lit(None).cast("string")})
    out = orders.unionByName(others)
    return (out.withColumn("instrument", F.when(needs, F.col("open_symbol")).otherwise(F.col(symbol)))
            .withColumn("resolve_error", F.when(needs & F.col("open_symbol").isNull(), F.lit(NOT_RESOLVED)))
            .drop("open_symbol", "remaining"))
