"""Registered queries of sources that are read from files: schedules, boxscores, typed CSV, and schedules that arrive.

Each lands files in the shared folder first, as a download would, and then runs the reader over all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asof_spark.sources import payloads
from asof_spark.sources.sinks import folder
from asof_spark.streaming import refresh

from .base import Base, sql
from .batch import SQL, box_texts, game_payload, query, schedule_payload
from .scoring import seasons_of

#: Games that a landed payload holds on average at most.
PAYLOAD_GAMES = 200


def land_schedules(b: Base, games: DataFrame, path: str) -> str:
    """Append schedule payloads, one a line. A date has as many as its games need, so that no payload grows with the table."""
    size = games.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days")).first()
    parts = max(1, math.ceil(size.n / (max(1, size.days) * PAYLOAD_GAMES)))
    grouped = games.groupBy("date", F.pmod(F.xxhash64("game_pk"), F.lit(parts))).agg(F.collect_list(game_payload()).alias("games"))
    grouped.select(schedule_payload(F.col("games")).alias("value")).write.mode("append").text(path)
    return path


@query(SQL["a1_schedule"])
def a1_schedule_files(b: Base):
    path = land_schedules(b, b.games, folder(b.spark, "schedules"))
    return payloads.read_schedule(b.spark, path, lines=True).select("game_pk", "season", "date", "game_type", "home_team_id", "away_team_id", "home_score", "away_score", "venue_id", "is_final", "home_win")


def landed_boxes(b: Base) -> DataFrame:
    path = folder(b.spark, "boxscores")
    box_texts(b).write.text(path)
    return payloads.read_boxscores(b.spark, path, lines=True)


@query(SQL["a2_pitchers"])
def a2_pitchers_files(b: Base):
    return payloads.parse_pitchers(landed_boxes(b)).select("game_pk", "side", "pitcher_id", "appearance_order", "is_starter", "ip_outs", "batters_faced", "is_opener", "decision")


@query(SQL["a3_batters"])
def a3_batters_files(b: Base):
    return payloads.parse_batters(landed_boxes(b)).select("game_pk", "side", "batter_id", "slot", "plate_appearances")


@query(sql("SELECT game_pk, date, home_score, venue_id, is_final, CASE WHEN game_pk % 3 = 1 THEN is_final WHEN game_pk % 3 = 2 THEN FALSE END AS flag FROM games"))
def a5_games_csv(b: Base):
    """Text booleans and empty fields of a CSV become booleans and nulls."""
    text = lambda c: F.when(c, "True").otherwise("False")
    flag = F.when(F.col("game_pk") % 3 == 1, text(F.col("is_final"))).when(F.col("game_pk") % 3 == 2, "False")
    path = folder(b.spark, "games-csv")
    b.games.select("game_pk", "date", "home_score", "venue_id", text(F.col("is_final")).alias("is_final"), flag.alias("flag")).write.option("header", True).csv(path)
    return payloads.read_games_csv(b.spark, path, "game_pk long, date date, home_score int, venue_id int, is_final boolean, flag boolean")


@query(sql("SELECT game_pk, season, date, home_score, away_score, home_win FROM games WHERE home_win IS NOT NULL AND game_pk % 50 <> 0"))
def m1_schedule_files(b: Base):
    """Files of a season arrive with those of the season before once more; the keys that are there add nothing."""
    landing, target = folder(b.spark, "schedules-arriving"), folder(b.spark, "finals")
    seasons = seasons_of(b.games)
    for season in seasons:
        land_schedules(b, b.games.filter(F.col("season").isin(season, season - 1)), landing)
        refresh.append_finals(refresh.schedule_stream(b.spark, landing, lines=True), target, f"{target}-log").start().awaitTermination()
    columns = "game_pk bigint, season int, date date, home_score int, away_score int, home_win int"
    if not seasons:
        return b.spark.createDataFrame([], columns)
    return b.spark.read.schema(columns).parquet(target).drop("batch")
