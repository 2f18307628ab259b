import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickforge.session import build_session  # noqa: E402

SF = os.environ.get("TICKFORGE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tickforge-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def fx(spark, sf):
    from tickforge.fixtures import Fixtures

    return Fixtures(spark, sf)
