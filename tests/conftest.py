import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyfield.session import ROWS_PER_TASK, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def split_groups(spark):
    """Force every key group above a handful of rows to be split into chunks."""
    spark.conf.set(ROWS_PER_TASK, "5")
    yield
    spark.conf.unset(ROWS_PER_TASK)


SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    return SF


def same_rows(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)

    def canon(df):
        return sorted(
            str([round(v, 8) if isinstance(v, float) else v for v in row]) for row in df.select(*columns).collect()
        )

    assert canon(a) == canon(b)
