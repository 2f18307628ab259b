"""State calls are made per block of orders and of users, not per order and account."""

from pyspark.sql import functions as F

from tickforge.streaming import stateful


class Calls:
    """A map state that counts how often it is opened."""

    def __init__(self):
        self.rows, self.opened = {}, 0

    def iterator(self):
        self.opened += 1
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_a_block_of_orders_is_one_call():
    import pandas as pd

    processor = stateful._Orders("bigint", 60)
    processor.state = calls = Calls()
    rows = [("p", i, "OrderPlaced", 0, 100 + i % 3, 5, False, i) for i in range(1000)] + [("p", i, "OrderMatched", 0, 100, 5, False, 2000) for i in range(990)]
    pdf = pd.DataFrame(rows, columns=["pool_id", "order_id", "kind", "side_code", "price", "quantity", "ends", "ts"])
    out = pd.concat(processor.handleInputRows((1, 0), iter([pdf]), None))
    assert calls.opened == 1 and len(calls.rows) == 10  # closed orders never reach the state
    assert (out["d_qty"].sum(), out["d_count"].sum()) == (50, 10)
    ends = pd.DataFrame([("p", 995, "OrderCancelled", 0, 0, 0, True, 3000)], columns=pdf.columns)
    out = pd.concat(processor.handleInputRows((1, 0), iter([ends]), None))
    assert len(calls.rows) == 9 and (out["d_qty"].sum(), out["d_count"].sum()) == (-5, -1)


def test_streams_are_keyed_by_block(spark, fx, tmp_path):
    for df, name in ((fx.event_log, "log"), (fx.ledger_events, "ledger")):
        df.limit(10).write.parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    plans = [stateful.stream_depth(read(fx.event_log, "log")), stateful.stream_balances(read(fx.ledger_events, "ledger"))]
    assert all("block" in p._jdf.queryExecution().analyzed().toString() for p in plans)
