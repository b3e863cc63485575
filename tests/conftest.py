import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark.sql import SparkSession


# Test modules build column expressions at import time, which needs a session.
SESSION = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "8g")
    .config("spark.ui.enabled", "false")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
