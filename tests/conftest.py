"""One local session for all tests, and small frames with known answers."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    from tabloom import generate_customers
    from tabloom.functions.storage import staged

    return staged(generate_customers(spark, 1500), "customers")


@pytest.fixture(scope="session")
def prices(spark):
    from tabloom import generate_customers
    from tabloom.functions.storage import staged

    return staged(generate_customers(spark, 1500, task="regression"), "prices")
