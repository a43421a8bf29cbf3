import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tickloom.schema import EVENT_SCHEMA
from tickloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4, memory="4g")
    yield session
    session.stop()


def expected_id(source, sequence):
    """The event id by its definition, in plain Python."""
    name = source.encode()
    return hashlib.sha256(b"tickloom:event-id:v1\0" + len(name).to_bytes(4, "big") + name + sequence.to_bytes(8, "big")).hexdigest()


IDS = {n: expected_id("feed/alpha", n) for n in (6, 7, 8, 9, 12)}
MAX = 9223372036854775807


def line(seq, payload, at=1650000000000000500, symbol="ZORB", **metadata):
    meta = {"eventId": IDS.get(seq, "0" * 64), "schemaVersion": {"major": 1, "minor": 0},
            "source": "feed/alpha", "venue": "XTST", "exchangeTimestamp": at, "sequenceNumber": seq,
            "rawEventReference": f"book/day7#{seq}"}
    meta.update(metadata)
    return json.dumps({"metadata": meta, "instrument": {"symbol": symbol}, "payload": payload})


# A book's day: a print before the opening, a quote, an order added, another one withdrawn in part, the first one filled in part.
TRADE = line(6, {"type": "TRADE", "tradeId": 9313, "aggressorSide": "SELL", "quantity": 9,
                 "price": {"mantissa": 31418, "scale": 2}}, at=1649999999000000001, symbol="QUIX", receiveTimestamp=1650000000000000777)
QUOTE = line(7, {"type": "QUOTE", "bid": {"price": {"mantissa": 5, "scale": 1}, "quantity": 3}})
ADD = line(8, {"type": "ORDER_ADDED", "orderId": 4207, "side": "BUY", "quantity": 730,
               "price": {"mantissa": 18725, "scale": 2}})
CANCEL = line(9, {"type": "ORDER_CANCELLED", "orderId": 4390, "cancelledQuantity": 15})
EXECUTE = line(12, {"type": "ORDER_EXECUTED", "orderId": 4207, "executedQuantity": 330}, at=0)


@pytest.fixture(scope="session")
def events(spark):
    """Canonical frame of lines, keyed by event type."""
    def build(*lines):
        return spark.createDataFrame([(text,) for text in lines], "value string").select(
            F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")

    return build
