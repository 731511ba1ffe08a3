import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2024, 10, 1)


@pytest.fixture(scope="session")
def long(spark):
    """long(tag=[(minute, value), ...], ...) -> a long table that starts at midnight."""

    def make(**tags):
        rows = [(t, START + timedelta(minutes=m), None if v is None else float(v)) for t, xs in tags.items() for m, v in xs]
        return spark.createDataFrame(rows, "`Tag de PI` string, timestamp timestamp_ntz, value double")

    return make
