"""The prediction log as files in buckets."""

from pyspark.sql import functions as F

from asof_spark.operators import predlog

SCHEMA = "date date, game_id long, p double"


def table(spark, rows):
    return spark.createDataFrame(rows, "date string, game_id long, p double").withColumn("date", F.col("date").cast("date"))


def stored(spark, path):
    return sorted((r.game_id, r.p) for r in predlog.read_log(spark, path, SCHEMA).collect())


def test_existing_rows_win_and_repeats_change_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stored(spark, path) == []
    first = table(spark, [("2020-01-01", i, 0.1) for i in range(50)])
    predlog.append_log(first, path, 0)
    again = table(spark, [("2020-01-02", i, 0.9) for i in range(45, 55)] + [("2020-01-02", 54, 0.9)])
    predlog.append_log(again, path, 1)
    want = [(i, 0.1) for i in range(50)] + [(i, 0.9) for i in range(50, 55)]
    assert stored(spark, path) == want
    predlog.append_log(again, path, 1)  # the same batch after a failure
    predlog.append_log(first, path, 2)
    predlog.append_log(first.limit(0), path, 3)
    assert stored(spark, path) == want


def test_a_batch_reads_its_own_buckets_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    predlog.append_log(table(spark, [("2020-01-01", i, 0.1) for i in range(500)]), path, 0)
    read, seen = predlog.read_log, []
    monkeypatch.setattr(predlog, "read_log", lambda *a: seen.append(read(*a)) or seen[-1])
    small = table(spark, [("2020-01-02", 3, 0.5), ("2020-01-02", 9001, 0.5)])
    predlog.append_log(small, path, 1)
    touched = [r[0] for r in small.select(predlog._bucket("game_id")).distinct().collect()]
    near = seen[0].filter(F.col("bucket").isin(touched) & (F.col("batch") != 1)).select("game_id")
    assert near.select(F.input_file_name().alias("f")).distinct().count() <= len(touched) < predlog.BUCKETS
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200]
    assert len(stored(spark, path)) == 501
