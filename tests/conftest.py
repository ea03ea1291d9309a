"""One small local session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


def most_rows(spark, df):
    """The rows of df, and the most rows that any step of its plan put out."""
    rows = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    at = runs.apply(runs.size() - 1)
    values = store.executionMetrics(at.executionId())
    counts, it = [0], values.valuesIterator()
    while it.hasNext():
        v = it.next().replace(",", "")
        if v.isdigit():
            counts.append(int(v))
    return rows, max(counts)
