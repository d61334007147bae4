import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talentloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """value(f, text, …): f applied to literal columns."""
    from pyspark.sql import functions as F

    def run(f, *args):
        names = [f"c{i}" for i in range(len(args))]
        df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {_type(a)}" for n, a in zip(names, args)))
        return df.select(f(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run


def _type(a):
    if isinstance(a, list):
        return "array<string>"
    if isinstance(a, (bytes, bytearray)):
        return "binary"
    return {bool: "boolean", int: "int", float: "double"}.get(type(a), "string")
