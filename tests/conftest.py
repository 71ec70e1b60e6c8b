import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    spark = session("4")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small DataFrame from column names and tuples."""

    def build(schema, rows):
        return spark.createDataFrame(rows, schema)

    return build
