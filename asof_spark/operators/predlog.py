"""Append-only prediction log: scoring a slate, logging, settling, grading."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import evaluate, to_long
from .ratings import score_snapshot

BASELINE = 0.540
COLUMNS = ("date", "game_id", "home_id", "away_id", "elo_prob_home", "baseline_prob_home", "home_won")


def score_slate(games: DataFrame, ratings: DataFrame, day: Column) -> DataFrame:
    """Log rows for the regular-season games of a date (all dates with a null day)."""
    rows = games.filter(F.col("game_type") == "R").filter(F.coalesce(F.col("date") == day, F.lit(True)))
    out = score_snapshot(rows, ratings)
    return out.select("date", F.col("game_pk").alias("game_id"), F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), "elo_prob_home", F.lit(BASELINE).alias("baseline_prob_home"), F.lit(None).cast("int").alias("home_won"))


def log_predictions(log: DataFrame, new: DataFrame) -> DataFrame:
    """log and the rows of new whose game_id it lacks; the existing row wins."""
    return log.unionByName(new.join(log.select("game_id"), "game_id", "left_anti").select(*log.columns))


#: Buckets of the stored log.
BUCKETS = 256


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored log with bucket and batch; no rows if nothing has been logged. schema: DDL of the log's columns."""
    kinds = f"{schema}, bucket int, batch long"
    try:
        return spark.read.schema(kinds).option("basePath", path).parquet(path)
    except AnalysisException as e:  # nothing written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def append_log(new: DataFrame, path: str, batch: int, key: str = "game_id") -> None:
    """Append the rows of new whose key the log at path lacks; of rows that repeat a key in new one stays.

    The log lies in buckets of the key, so of the history only the key column of the buckets that new falls into is read, and the
    side that is shuffled or broadcast is new's. Nothing is rewritten. A batch that is repeated after a failure writes its files again.
    """
    spark = new.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    rows = new.dropDuplicates([key]).withColumn("bucket", _bucket(key))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    near = read_log(spark, path, schema).filter(F.col("bucket").isin(touched) & (F.col("batch") != batch)).select(key, "bucket")
    # keys of new that are there already: as many as new at most, found without a shuffle of the history where new is small
    there = near.join(rows.select(key, "bucket"), [key, "bucket"]).select(key).distinct()
    fresh = rows.join(there, key, "left_anti").withColumn("batch", F.lit(batch).cast("long"))
    spark_mode = {"partitionOverwriteMode": "dynamic"}
    fresh.repartition("bucket").write.mode("overwrite").options(**spark_mode).partitionBy("batch", "bucket").parquet(path)


def settle(log: DataFrame, finals: DataFrame) -> DataFrame:
    """Fill home_won of pending rows from final scores; a tie stays null. finals: game_pk, home_win."""
    f = finals.select(F.col("game_pk").alias("game_id"), F.col("home_win").alias("__won"))
    return log.join(f, "game_id", "left").withColumn("home_won", F.coalesce("home_won", "__won")).drop("__won")


def report(log: DataFrame) -> DataFrame:
    long = to_long(log.filter("home_won is not null"), {"elo": "elo_prob_home", "baseline": "baseline_prob_home"}, "home_won")
    return evaluate(long, "model", at_half=True, clip=1e-12).select("model", "n", "accuracy", "log_loss")


def score_latest_day(log: DataFrame) -> DataFrame:
    """One row: the newest date with a settled row and its correct, total, pushes and pending counts, and a status."""
    day = log.agg(F.max(F.when(F.col("home_won").isNotNull(), F.col("date"))).alias("day"), F.count(F.lit(1)).alias("rows"))
    rows = log.join(F.broadcast(day), F.col("date") == F.col("day"), "right")  # one row of day
    settled, p = F.col("home_won").isNotNull(), F.col("elo_prob_home")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    right = settled & (((p > 0.5) & (F.col("home_won") == 1)) | ((p < 0.5) & (F.col("home_won") == 0)))
    status = F.when(F.max("rows") == 0, "no_log").when(F.max("day").isNull(), "pending").otherwise("ok")
    return rows.agg(F.max("day").alias("day"), count(right).alias("correct"), count(settled & (p != 0.5)).alias("total"), count(settled & (p == 0.5)).alias("pushes"), count(~settled & F.col("date").isNotNull()).alias("pending"), status.alias("status"))


def fingerprint(log: DataFrame, today: Column) -> DataFrame:
    """Rows before today: count and an order-free hash of all values."""
    old = log.filter(F.col("date") < today)
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(log.columns)])
    return old.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def staleness(snapshot: DataFrame, games: DataFrame, now: Column, hours: float = 3.0) -> DataFrame:
    """hours_old, skip (younger than `hours`), data_as_of."""
    age = snapshot.agg(((now.cast("long") - F.max("updated_at").cast("long")) / 3600.0).alias("hours_old"))
    return age.join(games.agg(F.max("date").alias("data_as_of"))).select("hours_old", F.coalesce(F.col("hours_old") < hours, F.lit(False)).alias("skip"), "data_as_of")  # two rows of one


def day_view(log: DataFrame, teams: DataFrame, day: Column) -> DataFrame:
    """Predictions of a date with team names; an unknown team shows its id."""
    name = lambda s: teams.select(F.col("team_id").alias(f"{s}_id"), F.col("team_name").alias(f"{s}_name"))
    rows = log.filter(F.col("date") == day).join(name("home"), "home_id", "left").join(name("away"), "away_id", "left")
    return rows.select("date", "game_id", *[F.coalesce(f"{s}_name", F.col(f"{s}_id").cast("string")).alias(f"{s}_name") for s in ("home", "away")], "elo_prob_home", "home_won")
