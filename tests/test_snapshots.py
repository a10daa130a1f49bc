"""Snapshots of games that arrive over several micro-batches."""

from pyspark.sql import functions as F

from asof_spark.streaming import refresh

SCHEMA = "game_pk long, is_final boolean, home_score int, away_score int, start_time_utc timestamp, ingest_seq long, event_time timestamp"


def test_the_best_snapshot_wins_over_batches_and_its_state_goes(spark, tmp_path):
    landed, out, log = (str(tmp_path / n) for n in ("landed", "out", "log"))
    day = lambda d: f"2021-05-{d:02d} 12:00:00"
    row = lambda pk, final, home, away, seq, d: (pk, final, home, away, None, seq, day(d))
    batches = [
        [row(1, False, None, None, 1, 1), row(2, True, 3, 2, 2, 1), row(3, False, None, None, 3, 1)],
        [row(1, True, None, None, 4, 1), row(2, False, None, None, 5, 2)],  # a final without score; a worse row of game 2
        [row(1, True, 5, 4, 6, 2)],  # the scored final replaces the earlier one
        [row(9, False, None, None, 7, 20)],  # ten days on: games 1 to 3 are settled
        [row(1, True, 0, 9, 8, 2), row(9, True, 1, 0, 9, 20)],  # too late for game 1
        [row(8, False, None, None, 10, 30)],
    ]
    states, dropped = [], 0
    for rows in batches:
        frame = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("start_time_utc", F.col("start_time_utc").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(landed)
        stream = refresh.collapse_snapshots(refresh.table_stream(spark, landed, SCHEMA, 100))
        query = stream.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out)
        query.awaitTermination()
        for p in query.recentProgress:
            dropped += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        states.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = {r.game_pk: (r.home_score, r.away_score) for r in spark.read.schema(SCHEMA).parquet(out).collect()}
    assert got == {1: (5, 4), 2: (3, 2), 9: (1, 0)}
    assert dropped == 1 and states[2] == 3 and states[-1] == 1
