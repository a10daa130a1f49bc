"""Filtering readers of the games table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import flag_matchups

# Game type codes.
REGULAR, POSTSEASON, EXHIBITION = ("R",), ("F", "D", "L", "W"), ("S", "E", "A")


def load_games(games: DataFrame, include_regular_season: bool = True, include_postseason: bool = False, include_exhibition: bool = False, finals_only: bool = True, matchups_only: bool = True, exclude_seasons: tuple[int, ...] = (2020,), seasons: tuple[int, ...] | None = None, must_exist: bool = False) -> DataFrame:
    """Games by type, state and season. must_exist makes an empty result an error (it costs a job)."""
    kinds = [*REGULAR * include_regular_season, *POSTSEASON * include_postseason, *EXHIBITION * include_exhibition]
    out = flag_matchups(games).filter("is_matchup").drop("is_matchup") if matchups_only else games
    out = out.filter(F.col("game_type").isin(kinds))
    if finals_only:
        out = out.filter("is_final")
    if exclude_seasons:
        out = out.filter(~F.col("season").isin(list(exclude_seasons)))
    if seasons is not None:
        out = out.filter(F.col("season").isin(list(seasons)))
    if must_exist and out.isEmpty():
        raise ValueError("no game meets the filters")
    return out


def type_counts(games: DataFrame) -> DataFrame:
    return games.groupBy("game_type").agg(F.count(F.lit(1)).alias("n"))


def elo_window(games: DataFrame, year: int, seasons: tuple[int, ...] | None = None) -> DataFrame:
    """The last five seasons and the current one (or the given ones), renamed for ratings."""
    played = load_games(games, include_postseason=True, exclude_seasons=())
    played = played.filter(F.col("season").isin(list(seasons))) if seasons else played.filter(F.col("season") >= year - 5)
    return played.select(
        F.col("game_pk").alias("game_id"), F.col("date").alias("game_date"), F.col("start_hour").alias("game_datetime"), F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"),
        F.concat(F.lit("Team "), "home_team_id").alias("home_name"), F.concat(F.lit("Team "), "away_team_id").alias("away_name"), "home_score", "away_score",
    )


def scope_games(games: DataFrame) -> DataFrame:
    return load_games(games, include_postseason=True, exclude_seasons=()).select("game_pk", "season", "date", "game_type", "home_team_id", "away_team_id", "home_score", "away_score")


def restrict_logs(logs: DataFrame, games: DataFrame) -> DataFrame:
    return logs.join(games.select("game_pk"), "game_pk", "left_semi")


def remaining_schedule(games: DataFrame, today: str, end: str) -> DataFrame:
    """Regular-season games of the date range that are not final and not among the finals by key."""
    finals = games.filter("is_final").select("game_pk")
    return games.filter(F.col("game_type").isin(list(REGULAR)) & F.col("date").between(F.lit(today).cast("date"), F.lit(end).cast("date")) & ~F.col("is_final")).join(finals, "game_pk", "left_anti").select("game_pk", "date", "home_team_id", "away_team_id")


def results_season(days: DataFrame, opening: str, closing: str) -> DataFrame:
    """For every today of `days`: before opening day the last season counts and is over; after the end date it is over."""
    d = F.col("today")
    before = d < F.lit(opening).cast("date")
    return days.select("today", F.when(before, F.year(d) - 1).otherwise(F.year(d)).alias("season"), (before | (d > F.lit(closing).cast("date"))).alias("season_over"))


def modelable(features: DataFrame, last_train_season: int) -> DataFrame:
    """Rows past the burn-in with a label, and the side of the split they fall on."""
    return features.filter("not is_burn_in and home_win is not null").withColumn("split", F.when(F.col("season") <= last_train_season, "train").otherwise("test"))
