"""Normalisation of raw games: results, final state, snapshots, idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def home_win(home: str = "home_score", away: str = "away_score", final: str = "is_final") -> Column:
    """1, 0 or null; null when not final, on a missing score and on a tie."""
    h, a = F.col(home), F.col(away)
    return F.when(F.col(final) & (h != a), (h > a).cast("int"))


def is_final(abstract: Column, detailed: Column) -> Column:
    low = F.lower(F.coalesce(detailed, F.lit("")))
    return F.coalesce((abstract == "Final") & ~low.contains("cancel") & ~low.contains("postpon"), F.lit(False))


def is_anomalous_season(season: Column, anomalous: int = 2020) -> Column:
    """True in the shortened season; a missing season is not."""
    return F.coalesce(season == anomalous, F.lit(False))


def dedupe_snapshots(df: DataFrame, key: str = "game_pk") -> DataFrame:
    """One row per key: final first, then scored, then the latest start (a missing one counts as latest), then the last ingested.

    A maximum of structs is combined before the shuffle, so a key with many snapshots is no hot task.
    """
    scored = (F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).cast("int")
    start = F.col("start_time_utc").cast("timestamp")
    rank = F.struct(F.col("is_final").cast("int"), scored, start.isNull().cast("int"), start, F.col("ingest_seq"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("row")).select("row.*")


def flag_matchups(df: DataFrame, regular: str = "R") -> DataFrame:
    """is_matchup: both teams appear in some regular-season row of the same frame."""
    ids = df.filter(F.col("game_type") == regular).select(F.explode(F.array("home_team_id", "away_team_id")).alias("id")).distinct()
    h, a = ids.select(F.col("id").alias("__h")), ids.select(F.col("id").alias("__a"))
    out = df.join(h, F.col("home_team_id") == F.col("__h"), "left").join(a, F.col("away_team_id") == F.col("__a"), "left")
    return out.withColumn("is_matchup", F.col("__h").isNotNull() & F.col("__a").isNotNull()).drop("__h", "__a")


def drop_reason(through: Column) -> Column:
    """Why a backfill leaves a row out; null keeps it."""
    return (
        F.when(~F.col("is_final"), "not_final")
        .when(F.col("home_score").isNull() | F.col("away_score").isNull(), "no_score")
        .when(F.col("home_score") == F.col("away_score"), "tie")
        .when(F.col("date") > through, "after_through")
    )


def filter_final(df: DataFrame, through: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the count of rows by reason ("kept" included)."""
    marked = df.withColumn("reason", drop_reason(through))
    return marked.filter("reason is null").drop("reason"), marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clamp_through(through: Column, today: Column) -> Column:
    return F.least(through, F.date_sub(today, 1))


def append_new(history: DataFrame, new: DataFrame, key: str = "game_pk") -> DataFrame:
    """history and the rows of new whose key it lacks; of rows of new with one key the last in column order counts.

    Appending the same rows again adds nothing.
    """
    once = new.groupBy(key).agg(F.max(F.struct(*new.columns)).alias("row")).select("row.*")
    return history.unionByName(once.join(history.select(key), key, "left_anti"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
