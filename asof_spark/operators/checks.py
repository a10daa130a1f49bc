"""Further audits: double-header codes, explained differences, log completeness, sources of every feature, refit on shuffled labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import LEAGUE_DAYS, WINDOW_OUTS
from .audits import count_if, per_column, shuffled_labels
from .metrics import evaluate
from .newton import Fit, fit_many
from .splits import MODEL_COLUMNS

# Codes of split and traditional double-headers.
DOUBLEHEADER_CODES = ("S", "Y")


def doubleheader_codes(games: DataFrame, code: str = "doubleheader_code") -> DataFrame:
    """Repeated (date, home, away) of the regular season: clean where the numbers differ and every code is a double-header's.

    A null number or code is not clean."""
    known = F.coalesce(F.col(code).isin(*DOUBLEHEADER_CODES), F.lit(False))
    rows = games.filter("game_type = 'R'").groupBy("date", "home_team_id", "away_team_id")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_number").alias("numbers"), count_if(~known).alias("other_codes"))
    return n.filter("n > 1").withColumn("clean", (F.col("n") == F.col("numbers")) & (F.col("other_codes") == 0))


def winner_nulls(games: DataFrame) -> DataFrame:
    """season: final games, ties, games without a winner that are no ties, and ties with one."""
    none, tie = F.col("home_win").isNull(), F.coalesce(F.col("home_score") == F.col("away_score"), F.lit(False))
    finals = games.filter("is_final").groupBy("season")
    return finals.agg(F.count(F.lit(1)).alias("n"), count_if(tie).alias("ties"), count_if(none & ~tie).alias("unexplained"), count_if(~none & tie).alias("won_ties"))


def explained_extras(differences: DataFrame, games: DataFrame, key: str = "game_pk", final: str = "is_final") -> DataFrame:
    """status, explained, n of reconcile's rows: an extra row is explained by a game that is not final, a differing row by nothing."""
    state = games.groupBy(key).agg(F.bool_or(final).alias("__final"))
    explained = (F.col("status") != "differs") & F.coalesce(~F.col("__final"), F.lit(False))
    return differences.join(state, key, "left").groupBy("status", explained.alias("explained")).agg(F.count(F.lit(1)).alias("n"))


def team_spots(games: DataFrame, season: int, most: int = 162) -> DataFrame:
    """team_id, games, first_date, last_date, ok for every team of a season under way: some games, but fewer than a whole season's."""
    rows = games.filter(F.col("season") == season).select("date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    n = rows.groupBy("team_id").agg(F.count(F.lit(1)).alias("games"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return n.withColumn("ok", F.col("games") < most)


def thin_sides(games: DataFrame, batters: DataFrame, least: int = 9) -> DataFrame:
    """game_pk, is_home, n of sides with fewer than `least` batters; a side without rows counts as 0."""
    sides = games.select("game_pk", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_home"))
    n = batters.groupBy("game_pk", "is_home").agg(F.count(F.lit(1)).alias("n"))
    return sides.join(n, ["game_pk", "is_home"], "left").select("game_pk", "is_home", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def outs_exceptions(games: DataFrame, rows: DataFrame, innings: int = 9) -> DataFrame:
    """is_home, reason, n of sides whose outs are no multiple of three, in games scheduled for `innings`.

    Reasons: called (stopped early or tied), walk_off (a visiting staff whose home side won), unexplained. A null number of
    innings played is the scheduled one, a null scheduled one is nine.
    """
    scheduled = F.coalesce("scheduled_innings", F.lit(9))
    called = (F.coalesce("innings_played", scheduled) < scheduled) | F.col("home_win").isNull()
    g = games.filter(scheduled == innings).select("game_pk", called.alias("called"), (F.col("home_win") == 1).alias("home_won"))
    odd = rows.groupBy("game_pk", "is_home").agg(F.sum("ip_outs").alias("outs")).filter("outs % 3 <> 0").join(g, "game_pk")
    reason = F.when(F.col("called"), "called").when(~F.col("is_home") & F.col("home_won"), "walk_off").otherwise("unexplained")
    return odd.groupBy("is_home", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def runs_both_ways(games: DataFrame, sides: DataFrame) -> DataFrame:
    """game_pk, is_home, kind, logged, score where a side's logged runs allowed or scored differ from the game's.

    sides: game_pk, is_home, allowed, scored. A null logged value counts as a difference."""
    mine = F.when(F.col("is_home"), F.col("home_score")).otherwise(F.col("away_score"))
    other = F.when(F.col("is_home"), F.col("away_score")).otherwise(F.col("home_score"))
    item = lambda kind, logged, score: F.struct(F.lit(kind).alias("kind"), logged.cast("long").alias("logged"), score.cast("long").alias("score"))
    both = F.explode(F.array(item("allowed", F.col("allowed"), other), item("scored", F.col("scored"), mine)))
    rows = sides.join(games.select("game_pk", "home_score", "away_score"), "game_pk").select("game_pk", "is_home", both.alias("x"))
    return rows.select("game_pk", "is_home", "x.*").filter(~F.col("logged").eqNullSafe(F.col("score")))


def plate_appearances(pitchers: DataFrame, batters: DataFrame) -> DataFrame:
    """difference, n: batters faced by a side's pitchers less the plate appearances of the other side's batters."""
    faced = pitchers.groupBy("game_pk", "is_home").agg(F.sum("batters_faced").alias("faced"))
    came = batters.groupBy("game_pk", (~F.col("is_home")).alias("is_home")).agg(F.sum("plate_appearances").alias("came"))
    return faced.join(came, ["game_pk", "is_home"]).groupBy((F.col("faced") - F.col("came")).alias("difference")).agg(F.count(F.lit(1)).alias("n"))


def required_columns(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return per_column(rows, lambda c: (count_if(F.col(c).isNull()), F.count(F.lit(1))), columns, "nulls", "n").withColumn("ok", F.col("nulls") == 0)


def row_band(rows: DataFrame, low: float, high: float) -> DataFrame:
    """season, games, n, per_game, ok: rows of a season for each of its games, against a band."""
    per = rows.groupBy("season").agg(F.count_distinct("game_pk").alias("games"), F.count(F.lit(1)).alias("n")).withColumn("per_game", F.col("n") / F.col("games"))
    return per.withColumn("ok", F.col("per_game").between(low, high))


def _source(name: str, games: Column, last: Column) -> Column:
    return F.struct(F.lit(name).alias("feature"), games.cast("long").alias("games"), last.alias("last_ord"))


def team_sources(long: DataFrame, venues: DataFrame) -> DataFrame:
    """game_pk, team_id, ord, feature, games, last_ord of rest days (the team's last game) and of the time-zone change (the season's)."""
    rows = long.join(venues.select("venue_id", "offset"), "venue_id", "left")
    last = F.lag("ord").over(Window.partitionBy("team_id").orderBy("ord"))
    season = Window.partitionBy("team_id", "season").orderBy("ord")
    zone = F.when(F.col("offset").isNotNull() & F.lag("offset").over(season).isNotNull(), F.lag("ord").over(season))
    rows = rows.withColumns({"__rest": last, "__zone": zone})
    one = lambda name, c: _source(name, F.col(c).isNotNull().cast("int"), F.col(c))
    return rows.select("game_pk", "team_id", "ord", F.explode(F.array(one("rest_days", "__rest"), one("tz_delta", "__zone"))).alias("s")).select("game_pk", "team_id", "ord", "s.*")


def pitcher_sources(rows: DataFrame) -> DataFrame:
    """game_pk, pitcher_id, ord, feature, games, last_ord of each appearance's own trailing window."""
    by = Window.partitionBy("pitcher_id").orderBy("ord")
    outs = F.coalesce(F.sum("ip_outs").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"__outs": outs, "__place": F.row_number().over(by), "__last": F.lag("ord").over(by)})
    stop = F.max("__place").over(Window.partitionBy("pitcher_id").orderBy("__outs").rangeBetween(Window.unboundedPreceding, -WINDOW_OUTS))
    own = _source("own_window", F.col("__place") - F.coalesce("__stop", F.lit(1)), F.col("__last"))
    return placed.withColumn("__stop", stop).select("game_pk", "pitcher_id", "ord", own.alias("s")).select("game_pk", "pitcher_id", "ord", "s.*")


def league_sources(ordered: DataFrame, starters: DataFrame) -> DataFrame:
    """game_pk, ord, feature, games, last_ord of the league pool: starts of the trailing year before each game."""
    n = starters.groupBy("game_pk").agg(F.count(F.lit(1)).alias("n"))
    rows = ordered.select("game_pk", "date", "ord").join(n, "game_pk", "left").withColumn("at", F.when(F.col("n") > 0, F.col("ord")))
    days = rows.groupBy("date").agg(F.sum("n").alias("n"), F.max("at").alias("at")).withColumn("__day", F.unix_date("date"))
    year = Window.orderBy("__day").rangeBetween(-LEAGUE_DAYS, -1)  # days alone
    days = days.select("date", F.coalesce(F.sum("n").over(year), F.lit(0)).alias("b_n"), F.max("at").over(year).alias("b_at"))
    inside = Window.partitionBy("date").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"i_n": F.coalesce(F.sum("n").over(inside), F.lit(0)), "i_at": F.max("at").over(inside)}).join(days, "date")
    pool = _source("league_pool", F.col("b_n") + F.col("i_n"), F.coalesce("i_at", "b_at"))
    return rows.select("game_pk", "ord", pool.alias("s")).select("game_pk", "ord", "s.*")


def source_violations(*sources: DataFrame) -> DataFrame:
    """feature, checked, violations: sources that are not strictly earlier than the game."""
    out = None
    for s in sources:
        part = s.groupBy("feature").agg(F.count(F.lit(1)).alias("checked"), count_if(F.col("last_ord") >= F.col("ord")).alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def doubleheader_containment(long: DataFrame, provenance: DataFrame) -> DataFrame:
    """checked, missing: games whose team played earlier that day, and those whose form window lacks that game."""
    season = Window.partitionBy("team_id", "season").orderBy("ord")
    second = long.withColumns({"__pk": F.lag("game_pk").over(season), "__date": F.lag("date").over(season)}).filter("__date = date")
    keys = provenance.filter("feature = 'form_15'").select("game_pk", "team_id", "keys")
    rows = second.select("game_pk", "team_id", "__pk").join(keys, ["game_pk", "team_id"], "left")
    return rows.agg(F.count(F.lit(1)).alias("checked"), count_if(~F.coalesce(F.array_contains("keys", F.col("__pk")), F.lit(False))).alias("missing"))


def shuffled_refit(train: DataFrame, test: DataFrame, columns: tuple[str, ...] = MODEL_COLUMNS, most: float = 0.03, floor: float = 0.685) -> DataFrame:
    """metric, value, ok on shuffled labels: every column's correlation (at most `most`) and the log loss of a refit (at least `floor`).

    train and test are read several times and should be stored. Without rows to fit on, every value is null and not ok."""
    mixed = lambda d: d.drop("home_win").join(shuffled_labels(d.select("game_pk", "home_win")), "game_pk")
    rows = mixed(train)
    flat = per_column(rows, lambda c: (F.corr(F.col(c).cast("double"), F.col("home_win").cast("double")),), columns, "value")
    flat = flat.select(F.col("name").alias("metric"), "value", F.coalesce(F.abs("value") <= most, F.lit(False)).alias("ok"))
    if train.isEmpty():
        return flat.unionByName(flat.sparkSession.createDataFrame([("log_loss", None, False)], flat.schema))
    loss = evaluate(fit_many(rows, [Fit("shuffled", columns)]).predict(mixed(test)).select(F.col("home_win").alias("y"), "p"))
    return flat.unionByName(loss.select(F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value"), F.coalesce(F.col("log_loss") >= floor, F.lit(False)).alias("ok")))


