import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ODD, frame  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table."""
    from lakestate.llm import common

    return common.documents(spark, "/root/testdata/sf0.001").cache()
