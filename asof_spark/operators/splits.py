"""Chronological splits and the model matrix."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ordered model vector.
MODEL_COLUMNS = ("home_form_15", "away_form_15", "home_run_diff_pg", "away_run_diff_pg", "home_rest_days", "away_rest_days", "away_tz_delta", "home_sp_fip", "away_sp_fip", "home_sp_k_rate", "away_sp_k_rate")
LEAST_GAMES = 15


def eval_rows(features: DataFrame) -> DataFrame:
    """Labelled rows where both teams have LEAST_GAMES earlier games; a null time-zone delta is 0."""
    rows = features.filter(F.col("home_win").isNotNull() & (F.col("home_games_played") >= LEAST_GAMES) & (F.col("away_games_played") >= LEAST_GAMES))
    return rows.withColumn("away_tz_delta", F.coalesce("away_tz_delta", F.lit(0))).withColumn("low_confidence", F.col("home_sp_low_confidence") | F.col("away_sp_low_confidence"))


def load_split(rows: DataFrame, seasons: tuple[int, ...], columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """Rows of the seasons, without any null in the model columns, by game_pk."""
    return split_rows(rows, seasons, columns).orderBy("game_pk")


def split_rows(rows: DataFrame, seasons: tuple[int, ...], columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """load_split in no order, for fits: they would sort the rows again in every pass."""
    return rows.filter(F.col("season").isin(list(seasons))).dropna(subset=list(columns))


def row_counts(rows: DataFrame, splits: dict[str, tuple[int, ...]]) -> DataFrame:
    name = F.lit(None).cast("string")
    for split, seasons in splits.items():
        name = F.when(F.col("season").isin(list(seasons)), split).otherwise(name)
    return rows.withColumn("split", name).filter("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("home_win").alias("base_rate"))


def validate_splits(tune: DataFrame, val: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """check, value, ok: overlaps, tune + val = train, order of dates."""
    k = lambda d: d.select("game_pk")
    one = lambda name, d: d.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), "value", (F.col("value") == 0).alias("ok"))
    both = k(tune).union(k(val))
    last = train.agg(F.max("date").alias("a")).join(test.agg(F.min("date").alias("b"))).select(F.lit("train_before_test").alias("check"), F.datediff("b", "a").cast("long").alias("value"), F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("ok"))
    checks = [one("tune_val", k(tune).intersect(k(val))), one("tune_test", k(tune).intersect(k(test))), one("val_test", k(val).intersect(k(test))), one("train_test", k(train).intersect(k(test))), one("missing_in_train", both.exceptAll(k(train))), one("extra_in_train", k(train).exceptAll(both)), last]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def degenerate_columns(train: DataFrame, columns: tuple[str, ...] = MODEL_COLUMNS, least: float = 1e-12) -> DataFrame:
    """name, variance, degenerate: population variance of every column in one aggregate."""
    one = train.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("variance")) for c in columns])).alias("v")).select("v.*").withColumn("degenerate", F.coalesce(F.col("variance") < least, F.lit(True)))


def get_xy(rows: DataFrame, columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """game_pk, features (vector) and label; a null is an error."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(rows)
    label = F.coalesce(F.col("home_win"), F.raise_error(F.lit("null label"))).cast("int")
    return vectors.select("game_pk", "features", label.alias("label"))
