import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.fixture
def values(spark):
    """Evaluates a column expression over one text column."""

    def run(texts, expression):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
        from pyspark.sql import functions as F

        return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]

    return run
