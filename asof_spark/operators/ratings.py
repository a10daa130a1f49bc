"""Elo ratings: replay in order inside independent pools, snapshots and scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asof_spark.functions.scalars import expected_home
from asof_spark.sources.sinks import folder

START, ADVANTAGE, STEP, REGRESSION = 1500.0, 25.0, 4.0, 1 / 3


def step(home: float, away: float, home_won: int, run_diff: float | None = None, k: float = STEP, advantage: float = ADVANTAGE) -> tuple[float, float]:
    """Ratings after a game; what one side gains the other loses. run_diff weighs the step by the margin."""
    chance = 1 / (1 + 10 ** (-(home + advantage - away) / 400))
    weight = 1.0
    if run_diff is not None:
        lead = (home - away) if home_won else (away - home)
        weight = math.log(abs(run_diff) + 1) * 2.2 / (lead * 0.001 + 2.2)
    change = k * weight * (home_won - chance)
    return home + change, away - change


def regress(rating: float) -> float:
    return rating + (START - rating) * REGRESSION


class Replay:
    """Ratings of one pool, game by game: predict, then update; all known teams regress at each new season."""

    def __init__(self, ratings: dict | None = None, season: int | None = None, use_margin: bool = False):
        self.ratings, self.season, self.use_margin = dict(ratings or {}), season, use_margin

    def play(self, season: int, home: int, away: int, home_won: float | None, run_diff: float | None) -> tuple[float, float]:
        if self.season is not None and season != self.season:
            self.ratings = {t: regress(r) for t, r in self.ratings.items()}
        self.season = season
        before = self.ratings.get(home, START), self.ratings.get(away, START)
        self.ratings[home], self.ratings[away] = before
        if home_won is not None and home_won == home_won:
            self.ratings[home], self.ratings[away] = step(*before, int(home_won), run_diff if self.use_margin else None)
        return before


#: Rows of a chain after its step: a game with the ratings before it, or (carried) a team's rating after the season in home_elo.
CHAIN = "pool long, season int, carried boolean, game_pk long, home_team_id int, home_elo double, away_elo double"


def _prepared(games: DataFrame, pool: str | None, order: tuple[str, ...], tie_as_loss: bool) -> DataFrame:
    won = F.col("home_win").cast("double")
    if tie_as_loss:
        won = F.when(F.col("is_final") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), (F.col("home_score") > F.col("away_score")).cast("double"))
    return games.select(
        (F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"), F.col("season").cast("int").alias("season"), F.lit(False).alias("carried"), F.col("game_pk").cast("long").alias("game_pk"), "home_team_id", "away_team_id",
        won.alias("won"), (F.col("home_score") - F.col("away_score")).cast("double").alias("run_diff"), F.lit(0.0).alias("rating"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
    )


def _replay(games: DataFrame, pool: str | None, order: tuple[str, ...], tie_as_loss: bool, use_margin: bool) -> tuple[DataFrame, DataFrame]:
    """CHAIN rows of all games, and of the ratings after them.

    Season by season: the small (pool, team, rating) table written after a season starts the chains of the next. Both
    tables go through the shared folder. A task takes the sorted games of its pools batch by batch, so that it holds
    the ratings of one pool and one batch, however many games there are.
    """
    keys = [f"o{i}" for i in range(len(order))]

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        names = CHAIN.replace(",", "").split()[::2]
        after = lambda: [(at, state.season, True, 0, t, r, r) for t, r in state.ratings.items()]
        for b in batches:
            out = []
            for key, season, carried, game, home, away, won, diff, rating in b.itertuples(index=False, name=None):
                if key != at:
                    out += after() if state else []
                    at, state = key, Replay(use_margin=use_margin)
                if carried:
                    state.ratings[home], state.season = rating, season
                else:
                    out.append((key, season, False, game, home, *state.play(season, home, away, won, diff)))
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame(after(), columns=names)

    spark, path = games.sparkSession, folder(games.sparkSession, "replay")
    rows = _prepared(games, pool, order, tie_as_loss)
    rows.write.partitionBy("season").parquet(f"{path}/games")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/games").select(*rows.columns)
    done, after = [], spark.createDataFrame([], CHAIN)
    for season in sorted(r[0] for r in stored.select("season").distinct().collect()):
        start = after.select("pool", "season", "carried", "game_pk", "home_team_id", F.lit(0).alias("away_team_id"), F.lit(None).cast("double").alias("won"), F.lit(None).cast("double").alias("run_diff"), F.col("home_elo").alias("rating"))
        chain = stored.filter(F.col("season") == season).unionByName(start, allowMissingColumns=True).repartition("pool").sortWithinPartitions("pool", F.desc("carried"), *keys)
        done.append(f"{path}/after-{season}")
        chain.drop(*keys).mapInPandas(play, CHAIN).write.parquet(done[-1])
        after = spark.read.schema(CHAIN).parquet(done[-1]).filter("carried")
    played = spark.read.schema(CHAIN).parquet(*done).filter("not carried") if done else after
    return played, after


def replay_elo(games: DataFrame, pool: str | None = None, order: tuple[str, ...] = ("date", "start_hour", "game_pk")) -> DataFrame:
    """game_pk, pool, home_elo, away_elo, elo_prob_home before each game. Null results are predicted but change nothing.

    Ratings are carried over all seasons, with the regression at each boundary. pool names teams that never meet those of
    other pools; without it all games are one chain. Pools run in parallel, the games of one pool one after another.
    """
    played = _replay(games, pool, order, False, False)[0].select("game_pk", "pool", "home_elo", "away_elo")
    return played.withColumn("elo_prob_home", expected_home(F.col("home_elo"), F.col("away_elo")))


def build_ratings(games: DataFrame, pool: str | None = None, use_margin: bool = False, order: tuple[str, ...] = ("start_hour", "game_number", "game_pk"), day: str | None = "date") -> DataFrame:
    """pool, team_id, rating after all games of all seasons; a tie counts as a loss of the home side here."""
    after = _replay(games, pool, (*([day] if day else []), *order), True, use_margin)[1]
    return after.select("pool", F.col("home_team_id").alias("team_id"), F.col("home_elo").alias("rating"))


def score_snapshot(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """games with home_rating, away_rating and elo_prob_home from a frozen table; an unseen team has the start rating."""
    side = lambda s: ratings.select(F.col("team_id").alias(f"{s}_team_id"), F.col("rating").alias(f"{s}_rating"))
    out = games.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    out = out.withColumns({f"{s}_rating": F.coalesce(f"{s}_rating", F.lit(START)) for s in ("home", "away")})
    return out.withColumn("elo_prob_home", expected_home(F.col("home_rating"), F.col("away_rating")))


def backtest(replayed: DataFrame, games: DataFrame, test_season: int, constant: float = 0.540) -> DataFrame:
    """Walk-forward rows of one season with the constant baseline; earlier seasons only warm up."""
    rows = games.filter((F.col("season") == test_season) & F.col("home_win").isNotNull()).select("game_pk", "season", "home_win")
    return rows.join(replayed.select("game_pk", "elo_prob_home"), "game_pk").withColumn("baseline_prob_home", F.lit(constant))


def matchup_prob(matchups: DataFrame, ratings: DataFrame) -> DataFrame:
    """matchups (home_id, away_id, neutral and other columns) with p, the chance of the home side by a frozen ratings table.

    A neutral game has no home advantage; a null neutral counts as false. An unseen team has the start rating.
    """
    side = lambda s: ratings.select(F.col("team_id").alias(f"{s}_id"), F.col("rating").alias(f"__{s}"))
    rows = matchups.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    home, away = F.coalesce("__home", F.lit(START)), F.coalesce("__away", F.lit(START))
    p = F.when(F.col("neutral"), expected_home(home, away, 0.0)).otherwise(expected_home(home, away))
    return rows.select(*matchups.columns, p.alias("p"))


def latest_names(games: DataFrame, order: tuple[str, ...] = ("date", "start_hour", "game_number", "game_pk")) -> DataFrame:
    """team_id, team_name: the name in a team's last game by `order` that gives one. games: both sides' team ids and names."""
    side = lambda s: F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_team_name").alias("team_name"))
    rows = games.select(F.struct(*order).alias("at"), F.explode(F.array(side("home"), side("away"))).alias("t"))
    return rows.filter("t.team_name is not null").groupBy("t.team_id").agg(F.max_by("t.team_name", "at").alias("team_name"))


#: Parts that the first sides of ordered pairs are dealt over.
DEALT = 64


def ordered_pairs(teams: DataFrame, key: str = "team_id") -> DataFrame:
    """a, b (structs of the columns of teams) for every ordered pair of different teams.

    The first sides are dealt over DEALT parts by key and the second ones repeated for each, so that no task makes all pairs.
    """
    own = F.struct(*teams.columns)
    a = teams.select(own.alias("a"), F.pmod(F.hash(key), F.lit(DEALT)).alias("__part"))
    b = teams.select(own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("__part"))
    return a.join(b, "__part").filter(F.col(f"a.{key}") != F.col(f"b.{key}")).select("a", "b")


def neutral_site(ratings: DataFrame) -> DataFrame:
    """P(a beats b) without home advantage for every ordered pair of the ratings table's teams."""
    a, b = F.col("a.rating"), F.col("b.rating")
    symmetric = 0.5 * (expected_home(a, b) + 1 - expected_home(b, a))
    return ordered_pairs(ratings.select("team_id", "rating")).select(
        F.col("a.team_id").alias("a_id"), F.col("b.team_id").alias("b_id"), expected_home(a, b, 0.0).alias("neutral_prob"), symmetric.alias("symmetrised_prob")
    )


def rating_table(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rating"), "team_id")))
