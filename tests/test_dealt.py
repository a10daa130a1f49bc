"""Sorts of games and logs are dealt over tasks by their rows, whatever Spark takes their size for."""

import os

import pytest
from pyspark.sql import functions as F

from asof_spark.operators import asof, segments
from asof_spark.plans.base import Base
from asof_spark.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def most(df):
    """Rows of the largest task that df leaves."""
    return df.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_tasks_follow_the_rows(spark, monkeypatch):
    b = Base(spark, SF)
    logs, ordered, windows = rows(b.logs), rows(b.ordered), rows(asof.pitcher_window(b.rows))
    features = rows(b.features)
    monkeypatch.setattr(segments, "TASK_ROWS", 100)
    dealt = Base(spark, SF)
    keys = dealt.rows.groupBy("pitcher_id").count().agg(F.max("count")).first()[0]
    assert most(tables.pitcher_logs(spark, SF)) < 250 < len(logs) / 8
    assert most(asof.canonical_order(dealt.played)) < 250
    assert most(asof.pitcher_window(dealt.rows)) < 6 * keys + 250 < len(windows)
    assert rows(dealt.logs) == logs and rows(dealt.ordered) == ordered and rows(asof.pitcher_window(dealt.rows)) == windows
    assert rows(dealt.features) == features
    none = dealt.rows.limit(0)
    assert asof.pitcher_window(none).count() == asof.canonical_order(dealt.played.limit(0)).count() == 0
