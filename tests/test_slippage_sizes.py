"""The slippage series of all sizes from one pass."""

from tickforge.fixtures import AS_OF
from tickforge.plans import slippage


def test_sizes_in_one_pass_equal_one_by_one(spark, fx):
    sizes = [None, "small", "medium", "large"]
    sc = spark.sparkContext
    sc.setJobGroup("sizes", "slippage by size")
    try:
        got = {(r["size"], r["timestamp"]): r for r in slippage.slippage_series_by_size(fx.trades, "30d", "daily", AS_OF, sizes).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("sizes"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 32
    for size in sizes:
        one = slippage.slippage_series(fx.trades, "30d", "daily", AS_OF, size=size).collect()
        assert len(one) == sum(1 for k in got if k[0] == size) > 0
        kept = [r for r in slippage.trade_size_filter(fx.trades, size).select("ts").collect() if r.ts <= AS_OF]
        assert 0 < sum(r.trade_count for r in one) <= len(kept) or not kept
        for r in one:
            g = got[size, r["timestamp"]]
            assert all(abs(g[c] - r[c]) < 1e-9 for c in one[0].__fields__ if c != "timestamp"), (size, r, g)
