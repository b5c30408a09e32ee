from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hourglass.session import configure
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="hourglass-test-", dir="/tmp")


def long_df(spark, rows):
    """rows: (series, 'YYYY-mm-dd HH:MM', value)."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "series string, t string, value double")
    return df.select("series", F.to_timestamp("t").alias("ts"), "value")
