import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", "8g")


@pytest.fixture
def one(spark):
    """Value of a column expression over one row."""
    from pyspark.sql import functions as F

    def value(make, **columns):
        df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
        return df.select(make(**{n: F.col(n) for n in columns}).alias("v")).first()["v"]

    return value
