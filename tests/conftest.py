import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stillwater.functions import quantiles  # noqa: E402
from stillwater.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return configure(s)


@pytest.fixture
def narrow_brackets(monkeypatch):
    """Groups of 200 rows and more are bracketed by the sketch."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 100)
