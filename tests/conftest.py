import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablelens.session import local_session
    s = local_session("*", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def case_sensitive(spark):
    """Switches spark.sql.caseSensitive for one test; the session itself has Spark's defaults."""
    yield lambda on: spark.conf.set("spark.sql.caseSensitive", str(on).lower())
    spark.conf.unset("spark.sql.caseSensitive")
