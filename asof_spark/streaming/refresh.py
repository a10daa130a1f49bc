"""The refresh loop as Structured Streaming: finals, snapshots, late settlement, online ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asof_spark.functions.scalars import expected_home
from asof_spark.operators.normalize import append_new
from asof_spark.operators.ratings import Replay
from asof_spark.sources.payloads import SCHEDULE, parse_schedule


def schedule_stream(spark: SparkSession, path: str, lines: bool = False, files: int | None = None) -> DataFrame:
    """Games of schedule files as they land under path, one payload a file or (lines) a line; files: most files of a batch."""
    reader = spark.readStream.schema(SCHEDULE).option("multiLine", not lines)
    return parse_schedule((reader.option("maxFilesPerTrigger", files) if files else reader).json(path))


def table_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_finals(stream: DataFrame, target: str, checkpoint: str, partition: str = "season"):
    """Write decided finals whose key the target lacks. Each batch is one folder named by its id, so a batch that is
    repeated after a failure writes the same folder again.

    Inside it rows lie by `partition`, a column that never changes for a key: of the history a batch reads only the
    keys in its own values of it (few), not all that was ever written.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark, new = df.sparkSession, df.filter("is_final and home_win is not null")
        stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        try:
            history = spark.read.schema(f"{stored}, batch long").option("basePath", target).parquet(target)
        except AnalysisException as e:  # nothing written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            history = new.withColumn("batch", F.lit(-1)).limit(0)
        values = [r[0] for r in new.select(partition).distinct().collect()]
        near = history.filter(F.col("batch") != batch_id).filter(F.col(partition).isin(values) | (F.col(partition).isNull() if None in values else F.lit(False)))
        once = append_new(new.limit(0), new)
        once.join(near.select("game_pk"), "game_pk", "left_anti").select(*new.columns).write.mode("overwrite").partitionBy(partition).parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def collapse_snapshots(stream: DataFrame, time: str = "event_time", delay: str = "2 days", quiet: str = "2 days") -> DataFrame:
    """The best snapshot of each key by the order of dedupe_snapshots, if it is final.

    A key's snapshots belong together while no more than `quiet` lies between two of them. The best so far is the key's state; it
    comes out, once, when the watermark (`delay` behind the newest event) has passed the end of the quiet time, and the
    state goes. Later rows are dropped and counted in the progress of the query (numRowsDroppedByWatermark). Columns that the
    order asks for and the stream lacks count as null.
    """
    there = lambda c: F.col(c) if c in stream.columns else F.lit(None)
    scored = there("home_score").isNotNull() & (F.col("away_score").isNotNull() if "away_score" in stream.columns else F.lit(True))
    start = there("start_time_utc").cast("timestamp")
    rank = F.struct(F.col("is_final").cast("int"), scored.cast("int"), start.isNull().cast("int"), start, there("ingest_seq").cast("long"), F.col(time))
    rows = stream.withWatermark(time, delay)
    best = rows.groupBy("game_pk", F.session_window(time, quiet)).agg(F.max_by(F.struct(*stream.columns), rank).alias("best"))
    return best.select("best.*").filter("is_final")


def settle_late(predictions: DataFrame, finals: DataFrame, delay: str = "1 day", within: str = "10 days") -> DataFrame:
    """Logged predictions with the results that arrive later; unsettled ones come out with nulls after the watermark.

    predictions: game_id, logged_at, ...; finals: game_pk, final_at, home_win.
    """
    p = predictions.withWatermark("logged_at", delay)
    f = finals.withWatermark("final_at", delay)
    on = (F.col("game_id") == F.col("game_pk")) & (F.col("final_at") >= F.col("logged_at")) & (F.col("final_at") <= F.col("logged_at") + F.expr(f"interval {within}"))
    return p.join(f, on, "leftOuter")


RATED = "pool long, game_pk long, home_elo double, away_elo double"


def online_ratings(stream: DataFrame) -> DataFrame:
    """Pre-game ratings game by game; the state of a pool is its ratings and season.

    stream: pool, game_pk, season, date, start_hour, home_team_id, away_team_id, home_win. Rows of a batch are played
    in order; a game that arrives after later ones were played is played at its arrival.
    """

    def play(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        teams, ratings, season = state.get if state.exists else ([], [], None)
        replay = Replay(dict(zip(teams, ratings, strict=True)), season)
        rows = pd.concat(list(frames)).sort_values(["date", "start_hour", "game_pk"])
        out = [(key[0], r.game_pk, *replay.play(r.season, r.home_team_id, r.away_team_id, r.home_win, None)) for r in rows.itertuples(index=False)]
        state.update((list(replay.ratings), list(replay.ratings.values()), int(replay.season)))
        yield pd.DataFrame(out, columns=["pool", "game_pk", "home_elo", "away_elo"])

    rated = stream.groupBy("pool").applyInPandasWithState(play, RATED, "teams array<int>, ratings array<double>, season int", "append", "NoTimeout")
    return rated.withColumn("elo_prob_home", expected_home(F.col("home_elo"), F.col("away_elo")))
