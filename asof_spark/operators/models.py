"""Win-probability models on MLlib: logistic regression, boosted trees, calibration, selection, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .metrics import evaluate
from .newton import Fit, fit_many, metrics_many
from .splits import MODEL_COLUMNS

# Inverse regularisation tried for the logistic model.
C_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
GAIN = 0.002
#: Less is better for fip, so its home side is negative.
ASSERTED_SIGNS = {"home_form_15": 1, "away_form_15": -1, "home_run_diff_pg": 1, "away_run_diff_pg": -1, "home_sp_fip": -1, "away_sp_fip": 1, "home_sp_k_rate": 1, "away_sp_k_rate": -1}
# The grid of the boosted model, 54 configurations.
LEARNING_RATES, MAX_ITERS, MAX_LEAVES, L2 = (0.03, 0.05, 0.1), (100, 200, 400), (15, 31, 63), (0.0, 1.0)
BOOSTED_GRID = tuple({"learning_rate": r, "max_iter": n, "leaves": m, "l2": l2} for r in LEARNING_RATES for n in MAX_ITERS for m in MAX_LEAVES for l2 in L2)


def fit_logistic(train: DataFrame, columns: tuple[str, ...] = MODEL_COLUMNS, c: float = 1.0, impute: bool = False) -> PipelineModel:
    """Scaler and logistic regression, fitted on train alone; optional median imputation inside the pipeline."""
    n = max(1, train.count())
    names = [f"{x}_filled" if impute else x for x in columns]
    first = [Imputer(strategy="median", inputCols=list(columns), outputCols=names)] if impute else []
    stages = [*first, VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"), LogisticRegression(labelCol="home_win", regParam=1 / (c * n), standardization=False, maxIter=100)]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias(name))


def metrics_of(model: PipelineModel, rows: DataFrame) -> dict:
    return evaluate(predict(model, rows).select(F.col("home_win").alias("y"), "p")).first().asDict()


def tune_c(tune: DataFrame, val: DataFrame, grid: tuple[float, ...] = C_GRID) -> DataFrame:
    """C, log_loss, chosen: the best C is adopted only if it gains GAIN over C = 1. All fits share their passes.

    Without rows to judge by the losses are null and C = 1 is chosen.
    """
    fitted = fit_many(tune, [Fit(f"C={c}", MODEL_COLUMNS, c) for c in sorted({*grid, 1.0})])
    loss = {f.c: m["log_loss"] for f, m in zip(fitted.fits, metrics_many(val, fitted))}
    best = 1.0 if loss[1.0] is None else min(loss, key=loss.get)
    chosen = best if best != 1.0 and loss[1.0] - loss[best] >= GAIN else 1.0
    return tune.sparkSession.createDataFrame([(float(c), v, c == chosen) for c, v in loss.items()], "C double, log_loss double, chosen boolean")


def sign_audit(train: DataFrame, expected: dict[str, int]) -> DataFrame:
    """name, univariate, multivariate, expected, ok, collinear: signs of one-feature fits against the full fit."""
    fitted = fit_many(train, [Fit("all", MODEL_COLUMNS), *[Fit(name, (name,)) for name in expected]])
    full, rows = fitted.coefficients(0), []
    for k, (name, sign) in enumerate(expected.items(), 1):
        one = fitted.coefficients(k)[name]
        rows.append((name, one, full[name], sign, bool(one * sign >= 0), bool(one * full[name] < 0)))
    return train.sparkSession.createDataFrame(rows, "name string, univariate double, multivariate double, expected int, ok boolean, collinear boolean")


def search_boosted(tune: DataFrame, val: DataFrame, grid: tuple[dict, ...] = BOOSTED_GRID, columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """config, its values and log_loss on val (null without rows), for every configuration of the grid.

    The first n trees of a longer fit are the fit of n iterations, so configurations that differ in max_iter alone share
    the longest one's trees. All fits are grown side by side (boosting.boost).
    """
    alike = list(dict.fromkeys((g["learning_rate"], g["leaves"], g["l2"]) for g in grid))
    at = tuple(sorted({g["max_iter"] for g in grid}))
    losses = boosting.boost(tune, val, [boosting.Fit(*a) for a in alike], columns, at[-1], at)
    rows = [(i, g["learning_rate"], g["max_iter"], g["leaves"], g["l2"], losses.get((alike.index((g["learning_rate"], g["leaves"], g["l2"])), g["max_iter"]))) for i, g in enumerate(grid)]
    return tune.sparkSession.createDataFrame(rows, "config int, learning_rate double, max_iter int, leaves int, l2 double, log_loss double")


def select_config(search: DataFrame, within: float = GAIN) -> DataFrame:
    """The simplest configuration within `within` of the best: few iterations, few leaves, much l2, small steps."""
    best = search.agg(F.min("log_loss").alias("best"))
    near = search.join(F.broadcast(best)).filter(F.col("log_loss") <= F.col("best") + within)  # one row
    return near.orderBy("max_iter", "leaves", F.desc("l2"), "learning_rate", "config").limit(1).drop("best")


def winner_gate(spark: SparkSession, logistic_loss: float, boosted_loss: float, override: str | None = None) -> DataFrame:
    gain = logistic_loss - boosted_loss
    winner = override or ("boosted" if gain >= GAIN else "logistic")
    return spark.createDataFrame([(winner, float(logistic_loss), float(boosted_loss), float(gain), gain > 0.02, override is not None)], "winner string, logistic_loss double, boosted_loss double, gain double, suspicious boolean, overridden boolean")


def platt(base: PipelineModel, val: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Sigmoid calibration fitted on val alone; returns a function that adds p."""
    logit = F.ln(F.col("raw_p") / (1 - F.col("raw_p")))
    clip = F.least(F.greatest(F.col("raw_p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    prepare = lambda rows: predict(base, rows, "raw_p").withColumn("raw_p", clip).withColumn("margin", logit)
    assembler = VectorAssembler(inputCols=["margin"], outputCol="margin_vector")
    fitted = LogisticRegression(featuresCol="margin_vector", labelCol="home_win").fit(assembler.transform(prepare(val)))
    return lambda rows: fitted.transform(assembler.transform(prepare(rows))).select(*rows.columns, "raw_p", vector_to_array("probability")[1].alias("p"))


def serve(features: DataFrame, model_p: Column, elo_p: Column, least_games: int = 15) -> DataFrame:
    """p, served_model and fallback_reason: Elo serves while a side has fewer than least_games games."""
    cold = F.least("home_games_played", "away_games_played") < least_games
    missing = model_p.isNull()
    return features.withColumns({"p": F.when(cold | missing, elo_p).otherwise(model_p), "served_model": F.when(cold | missing, "elo").otherwise("model"), "fallback_reason": F.when(cold, "cold_start").when(missing, "missing_features")})


def metric_deltas(with_: DataFrame, without: DataFrame) -> DataFrame:
    """Differences of the metrics of two runs on the same rows and the too-good alarm."""
    a, b = evaluate(with_), evaluate(without)
    both = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).join(b)  # two rows of one
    acc, loss = F.col("a_accuracy") - F.col("accuracy"), F.col("a_log_loss") - F.col("log_loss")
    return both.select(F.col("a_n").alias("n"), acc.alias("accuracy_delta"), loss.alias("log_loss_delta"), ((acc > 0.010) | (loss < -0.005)).alias("too_good"))


def ablations(train: DataFrame, test: DataFrame, columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """kind (only, without), name, log_loss, accuracy for each column alone and left out."""
    kinds = [(kind, c, used) for c in columns for kind, used in (("only", (c,)), ("without", tuple(x for x in columns if x != c)))]
    fitted = fit_many(train, [Fit(f"{kind} {c}", used) for kind, c, used in kinds])
    rows = [(kind, c, m["log_loss"], m["accuracy"]) for (kind, c, _), m in zip(kinds, metrics_many(test, fitted))]
    return train.sparkSession.createDataFrame(rows, "kind string, name string, log_loss double, accuracy double")


def _checked(p: pd.Series, rows: int) -> np.ndarray:
    p = pd.Series(list(p), dtype=float)
    if len(p) != rows:
        raise ValueError(f"{len(p)} probabilities for {rows} rows")
    if not ((p > 0) & (p < 1)).all():
        raise ValueError("probabilities must lie in (0, 1)")
    return p.to_numpy()


def score_with(rows: DataFrame, columns: tuple[str, ...], fn: Callable[[pd.DataFrame], pd.Series], key: str = "game_pk") -> DataFrame:
    """key, p from a user function on batches; one probability in (0, 1) per row or an error."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key].to_numpy(), "p": _checked(fn(b[list(columns)]), len(b))})

    return rows.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, p double")


def matchups_with(matchups: DataFrame, components: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], key: str = "game_pk") -> DataFrame:
    """key, p: chance of the home side of games that need be on no schedule, by a user function on batches.

    matchups: key, home_id, away_id, neutral; components: team_id and what the function wants to know of a team. It gets
    home_<c> and away_<c> of each component (nulls for an unknown team) and gives a probability in (0, 1) for each row.
    It has no home advantage to leave out, so for a neutral game the sides are exchanged as well: half of p + 1 - p'
    counts. A null neutral counts as false.
    """
    names = [c for c in components.columns if c != "team_id"]
    kind = dict(matchups.dtypes)[key]
    side = lambda s: components.select(F.col("team_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in names])
    rows = matchups.select(key, "home_id", "away_id", F.coalesce("neutral", F.lit(False)).alias("neutral")).join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    home, away = [f"home_{c}" for c in names], [f"away_{c}" for c in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[home + away]
            p, neutral = _checked(fn(x), len(b)), b["neutral"].to_numpy(dtype=bool)
            if neutral.any():
                exchanged = x[neutral].rename(columns=dict(zip(home + away, away + home, strict=True)))[home + away]
                p[neutral] = 0.5 * (p[neutral] + 1 - _checked(fn(exchanged), int(neutral.sum())))
            yield pd.DataFrame({key: b[key].to_numpy(), "p": p})

    return rows.select(key, "neutral", *home, *away).mapInPandas(run, f"{key} {kind}, p double")
