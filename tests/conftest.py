import os

import pytest
from pyspark.sql import SparkSession

from siltstone.session import configure


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    return configure(found)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
