from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyframe-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FOLDER = os.environ.get("TALLYFRAME_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def built(spark):
    """Registered queries as frames over the given tables, each built once."""
    from tallyframe.checks import registry

    queries, frames = registry.queries(), {}

    def frame(name):
        if name not in frames:
            frames[name] = queries[name](spark, FOLDER)
        return frames[name]

    return frame
