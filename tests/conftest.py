import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner.session import build_session  # noqa: E402


# built here because test modules build columns when they are imported
SESSION = build_session(
    "tests",
    "local[8]",
    **{
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one column over one row of named string values."""

    def run(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
        return row.select(column.alias("out")).first()["out"]

    return run
