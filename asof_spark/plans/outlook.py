"""Registered queries of parts of ratings, metrics, brackets and the model seam."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asof_spark.operators import metrics, models, ratings, standings

from .base import DIGITS, Base, replay_sql, sql
from .batch import _AFTER, _BY_NUMBER, query
from .scoring import sim_field, sim_sql, sim_teams, stored

# --- ratings -------------------------------------------------------------------------------------------------

# The tables have no names; a team is named anew every season.
_NAME = lambda team: f"'Team ' || {team} || ' of ' || season"


@query(replay_sql(f"""SELECT team_id, rating, team_name FROM ({_AFTER}) JOIN (SELECT team_id, arg_max(name, n) AS team_name FROM (
    SELECT h - 1 AS team_id, {_NAME("(h - 1)")} AS name, n FROM line UNION ALL SELECT a - 1, {_NAME("(a - 1)")}, n FROM line) GROUP BY 1) USING (team_id)""", _BY_NUMBER, won="CAST(home_score > away_score AS INT)"))
def e4_named_ratings(b: Base):
    names = {f"{s}_team_name": F.concat(F.lit("Team "), F.col(f"{s}_team_id"), F.lit(" of "), F.col("season")) for s in ("home", "away")}
    return ratings.build_ratings(b.played).join(ratings.latest_names(b.played.withColumns(names)), "team_id").select("team_id", "rating", "team_name")


# --- metrics -------------------------------------------------------------------------------------------------


def _band(metric: str, low: float, high: float) -> str:
    return f"SELECT '{metric}_accuracy' AS metric, round({metric}_acc, {DIGITS}) AS value, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, {metric}_acc BETWEEN {low} AND {high} AS ok FROM m"


@query(sql(f"""SELECT * FROM (WITH m AS (SELECT avg(CASE WHEN 0.54 > 0.5 THEN y ELSE 1 - y END) AS constant_acc, avg(CASE WHEN elo > 0.5 THEN y ELSE 1 - y END) AS elo_acc,
    -avg(CASE WHEN y = 1 THEN ln(0.54::DOUBLE) ELSE ln(1 - 0.54::DOUBLE) END) AS constant_loss, -avg(CASE WHEN y = 1 THEN ln(elo) ELSE ln(1 - elo) END) AS elo_loss FROM scored)
  {_band("constant", 0.51, 0.57)} UNION ALL {_band("elo", 0.52, 0.6)} UNION ALL SELECT 'elo_log_loss', round(elo_loss, {DIGITS}), NULL, round(constant_loss, {DIGITS}), elo_loss < constant_loss FROM m)""", "scored"))
def h13_baseline_bands(b: Base):
    return metrics.baseline_bands(metrics.to_long(b.scored, {"constant": "constant", "elo": "elo"}, "home_win"))


# --- brackets ------------------------------------------------------------------------------------------------


def first_round(field: DataFrame) -> DataFrame:
    """sim, round, hi, lo of both first-round slots of every league: seed 3 meets 6, and 4 meets 5."""
    pick = lambda s: F.max(F.when(F.col("seed") == s, F.col("team_id")))
    slots = field.groupBy("sim", "league").agg(F.array(*[F.struct(pick(hi).alias("hi"), pick(lo).alias("lo")) for hi, lo in ((3, 6), (4, 5))]).alias("slots"))
    return slots.select("sim", F.lit("first").alias("round"), F.explode("slots").alias("s")).select("sim", "round", "s.hi", "s.lo")


@query(
    sim_sql(
        """SELECT round, a_id, b_id, CASE WHEN round IS NOT NULL THEN coalesce(n, 0) END AS n
        FROM (SELECT a.team_id AS a_id, b.team_id AS b_id, unnest(['first', NULL]) AS round FROM teams a JOIN teams b ON a.team_id < b.team_id)
        LEFT JOIN (SELECT least(a.team_id, b.team_id) AS a_id, greatest(a.team_id, b.team_id) AS b_id, count(*) AS n FROM field a
          JOIN field b ON b.sim = a.sim AND b.league = a.league AND ((a.seed = 3 AND b.seed = 6) OR (a.seed = 4 AND b.seed = 5)) GROUP BY ALL) USING (a_id, b_id)"""
    )
)
def j12_pair_occurrences(b: Base):
    """Every pair of teams in the first round, and in a single game, which is no round."""
    brackets = stored(b, first_round(sim_field(b)), "brackets")
    pairs = ratings.ordered_pairs(sim_teams(b)).filter("a.team_id < b.team_id").select(F.col("a.team_id").alias("a_id"), F.col("b.team_id").alias("b_id"))
    rounds = pairs.select(F.explode(F.array(F.lit("first"), F.lit(None).cast("string"))).alias("round"), "a_id", "b_id")
    return standings.pair_occurrences(brackets, rounds)


# --- model seam ----------------------------------------------------------------------------------------------


def by_rating(x: pd.DataFrame) -> pd.Series:
    """A model that a user may pass: the Elo rule with the home advantage."""
    gap = x["home_rating"].fillna(ratings.START) + ratings.ADVANTAGE - x["away_rating"].fillna(ratings.START)
    return 1 / (1 + 10 ** (-gap / 400))


_P = lambda gap: f"(1 / (1 + pow(10, -({gap}) / 400)))"


@query(sql(f"""SELECT game_pk, round({_P("CASE WHEN neutral THEN hr - ar ELSE hr + 25 - ar END")}, {DIGITS}) AS elo_p, round(CASE WHEN neutral THEN 0.5 * ({_P("hr + 25 - ar")} + 1 - {_P("ar + 25 - hr")}) ELSE {_P("hr + 25 - ar")} END, {DIGITS}) AS model_p
  FROM (SELECT *, coalesce(game_pk % 4 = 0, FALSE) AS neutral FROM rated)""", "scored"))
def n1_matchup_prob(b: Base):
    """The pairing of every game as one that is on no schedule; of four, one is on neutral ground, for some that is not known."""
    neutral = F.when(F.col("game_pk") % 4 == 0, True).when(F.col("game_pk") % 4 == 1, False)
    matchups = b.games.select("game_pk", F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), neutral.alias("neutral"))
    elo = ratings.matchup_prob(matchups, b.ratings).select("game_pk", F.col("p").alias("elo_p"))
    return elo.join(models.matchups_with(matchups, b.ratings.select("team_id", "rating"), by_rating).select("game_pk", F.col("p").alias("model_p")), "game_pk")
