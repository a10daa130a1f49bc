"""Two-sided event tables derived from the order tables: games, pitcher logs, venues, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order as a game between two of thirty teams."""
    o = _read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("game_pk"),
        F.year("o_orderdate").alias("season"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderkey") % 24).cast("int").alias("start_hour"),
        (1 + F.col("o_orderkey") % 2).cast("int").alias("game_number"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "W").when(F.col("o_orderpriority") == "5-LOW", "S").otherwise("R").alias("game_type"),
        (F.col("o_orderstatus") != "P").alias("is_final"),
        (F.col("o_custkey") % 30).cast("int").alias("home_team_id"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 29) % 30).cast("int").alias("away_team_id"),
        (F.floor("o_totalprice") % 10).cast("int").alias("home_score"),
        (F.floor(F.col("o_totalprice") / 10) % 10).cast("int").alias("away_score"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey") % 30).cast("int").alias("venue_id"),
    )
    from asof_spark.operators.normalize import home_win

    return rows.withColumn("home_win", home_win())


def pitcher_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (game, pitcher) with integer counts; the first pitcher of each side is its starter."""
    from asof_spark.operators import segments

    li = _read(spark, sf_dir, "lineitem")
    li = segments.deal(li, li.count(), "l_orderkey")  # serves the sums and the window
    qty, lines = F.sum("l_quantity").cast("long"), F.sum("l_linenumber").cast("long")
    flag = lambda v: F.sum(F.when(F.col("l_returnflag") == v, 1).otherwise(0)).cast("long")
    rows = li.groupBy(F.col("l_orderkey").alias("game_pk"), F.col("l_suppkey").alias("pitcher_id")).agg(
        (qty % 28).alias("ip_outs"), flag("R").alias("home_runs"), (lines % 5).alias("walks"), flag("N").alias("hit_by_pitch"), (qty % 11).alias("strikeouts")
    )
    from pyspark.sql.window import Window

    side = Window.partitionBy("game_pk", "is_home")
    return (
        rows.withColumn("is_home", F.col("pitcher_id") % 2 == 0)
        .withColumn("batters_faced", F.col("ip_outs") + F.col("home_runs") + F.col("walks") + F.col("hit_by_pitch") + 1)
        .withColumn("is_starter", F.col("pitcher_id") == F.min("pitcher_id").over(side))
    )


def venues(games_: DataFrame) -> DataFrame:
    """venue_id, name, tz_id and offset of every venue that occurs."""
    ids = games_.select("venue_id").filter("venue_id is not null").distinct()
    return ids.select("venue_id", F.concat(F.lit("Venue "), F.col("venue_id").cast("string")).alias("name"), F.concat(F.lit("tz"), (F.col("venue_id") % 4).cast("string")).alias("tz_id"), (-4 - F.col("venue_id") % 4).cast("int").alias("offset"))


def teams(games_: DataFrame) -> DataFrame:
    """team_id, name, league and division of every team that occurs."""
    ids = games_.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    return ids.select("team_id", F.concat(F.lit("Team "), F.col("team_id").cast("string")).alias("team_name"), (F.col("team_id") % 2).alias("league"), (F.col("team_id") % 6).alias("division"))


def ratings(games_: DataFrame) -> DataFrame:
    """A fixed rating for every team that occurs but the last, which is unseen."""
    return teams(games_).filter("team_id < 29").select("team_id", "team_name", (1500.0 + (F.col("team_id") * 7) % 90 - 45).cast("double").alias("rating"))
