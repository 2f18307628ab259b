"""Connected components and the double limiter: components streamed in one pass, larger ones by rounds."""

import random

from tickforge.operators.keyed import components
from tickforge.plans import limits


def test_components_of_chains_stars_and_loops(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    edges = [*chain, *[("z0", f"z{i}") for i in range(1, 30)], ("x", "x"), ("p", "q"), ("q", "p"), ("p", None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    want = {n: "n000" for e in chain for n in e} | {f"z{i}": "z0" for i in range(30)} | {"x": "x", "p": "p", "q": "p"}
    assert got == want


def _requests(spark):
    rng, asked = random.Random(3), []
    for i in range(400):
        g = rng.randrange(4)
        asked.append((rng.choice("aAbBc") + str(g), f"ip{g}-{rng.randrange(2)}", rng.randrange(90_000), i))
    return spark.createDataFrame(asked, "address string, ip string, ts bigint, seq bigint")


def test_streamed_components_equal_the_rounds(spark):
    req = _requests(spark)
    streamed, rounds, mixed = limits.both_limits(req), limits.both_limits(req, rows=1), limits.both_limits(req, rows=100)
    for other in (rounds, mixed):
        assert streamed.exceptAll(other).count() == 0 and other.exceptAll(streamed).count() == 0
    assert streamed.count() == 400 and 0 < streamed.filter("allowed").count() < 400


def test_coupled_limiters_need_no_rounds(spark):
    """The jobs of the double limiter do not grow with the windows that correct each other."""
    sc = spark.sparkContext
    sc.setJobGroup("both", "both limits")
    try:
        limits.both_limits(_requests(spark)).collect()
        assert len(sc.statusTracker().getJobIdsForGroup("both")) < 60
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
