import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scrub.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="scrub-tests")
    yield s
    s.stop()


def one(spark, value, expr):
    """Evaluate a Column function on one string value."""
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(df["v"]).alias("r")).first()["r"]


def many(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", expr(df["v"]).alias("r")).orderBy("i").collect()]
