import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cotejo.session import local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of text cells."""

    def run(expr, *cells):
        names = [f"c{i}" for i in range(len(cells))]
        schema = ", ".join(f"{n} string" for n in names)
        row = spark.createDataFrame([tuple(cells)], schema).select(expr.alias("x")).first()
        return row["x"]

    return run
