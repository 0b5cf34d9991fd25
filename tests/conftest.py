import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rallylens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("RALLYLENS_DRIVER_MEMORY", "4g")
    session = local_session(4, "rallylens-tests", f"file:{tmp_path_factory.mktemp('shared')}")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture
def evaluate(spark):
    """Value of a column expression for one text."""

    def run(expression, value):
        df = spark.createDataFrame([(value,)], "t string").repartition(1)
        return df.select(expression.alias("v")).first().v

    return run
