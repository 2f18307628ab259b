"""The slippage summary of a symbol that has all trades."""

import pytest

from tickforge.fixtures import AS_OF
from tickforge.plans import slippage


@pytest.fixture
def one_symbol(spark):
    """600 trades of one symbol at 150 prices, every tenth of 2,000 or more, some without a price."""
    return spark.createDataFrame(
        [("s", AS_OF - i * 60, None if i % 50 == 7 else i % 150 + 1.0, 10.0 if i % 10 else 2000.0 + i, "Sell" if i % 2 else "Buy") for i in range(600)],
        "symbol string, ts long, price double, quote_qty double, side string")


def test_no_task_has_all_trades_of_a_symbol(spark, one_symbol, monkeypatch):
    """The counted values of the only symbol come from several tasks; without broadcasts, as small tables would all be one."""
    settled = []
    keep = slippage.settle
    def seen(df):
        settled.append(df.rdd.glom().map(len).collect())
        return keep(df)
    monkeypatch.setattr(slippage, "settle", seen)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        slippage.symbol_slippage_summary(one_symbol, "30d", AS_OF).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert settled and all(max(sizes) < sum(sizes) / 2 for sizes in settled), settled


def test_summary_against_all_sizes_mean(one_symbol):
    """A size's slippage is taken against the mean of all trades, and one without a price counts in no mean."""
    rows = one_symbol.collect()
    mean = sum(r.price for r in rows if r.price is not None) / sum(1 for r in rows if r.price is not None)
    for size, low, high in ((None, 0, 1e9), ("small", 0, 1000), ("medium", 1000, 10000)):
        part = [r for r in rows if low <= r.quote_qty < high]
        slips = sorted(round(abs(r.price - mean) / mean * 100, 6) for r in part if r.price is not None)
        got = slippage.symbol_slippage_summary(one_symbol, "30d", AS_OF, size=size).head()
        assert got.trade_count == len(part) and got.buy_trades == sum(1 for r in part if r.side == "Buy")
        assert abs(got.max_slippage - slips[-1]) < 1e-5
        assert got.first_trade_time == min(r.ts for r in part) and got.last_trade_time == max(r.ts for r in part)
        assert abs(got.avg_trade_value - sum(r.quote_qty for r in part) / len(part)) < 1e-9
    assert slippage.symbol_slippage_summary(one_symbol, "30d", AS_OF, size="large").head() is None
