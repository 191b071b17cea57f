import os

import pytest
from pyspark.sql import SparkSession

from millrace import prepare


# Lets the Python workers import the doubles of the test modules.
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
