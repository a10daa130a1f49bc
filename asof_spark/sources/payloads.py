"""Nested schedule and boxscore payloads, dimensions and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asof_spark.functions.scalars import decision, ip_to_outs, is_opener
from asof_spark.operators.normalize import home_win, is_anomalous_season, is_final

_SIDE = "struct<team:struct<id:bigint,name:string>,score:int,isWinner:boolean,leagueRecord:struct<wins:int,losses:int>,probablePitcher:struct<id:bigint>>"
GAME = f"struct<gamePk:bigint,season:string,officialDate:string,gameDate:string,gameType:string,status:struct<abstractGameState:string,detailedState:string>,doubleHeader:string,gameNumber:int,rescheduledFrom:string,venue:struct<id:bigint>,linescore:struct<scheduledInnings:int,currentInning:int>,decisions:struct<winner:struct<id:bigint>,loser:struct<id:bigint>>,teams:struct<home:{_SIDE},away:{_SIDE}>>"
SCHEDULE = f"dates array<struct<date:string,games:array<{GAME}>>>"
_PITCHING = "struct<inningsPitched:string,battersFaced:int,runs:int,strikeOuts:int,baseOnBalls:int,homeRuns:int,hitByPitch:int,note:string>"
_BATTING = "struct<plateAppearances:int,atBats:int,hits:int,runs:int>"
_BOX = f"struct<team:struct<id:bigint>,pitchers:array<bigint>,players:map<string,struct<person:struct<id:bigint,fullName:string>,battingOrder:string,position:struct<abbreviation:string>,stats:struct<pitching:{_PITCHING},batting:{_BATTING}>>>>"
BOXSCORE = f"game_pk bigint, winning_pitcher_id bigint, losing_pitcher_id bigint, teams struct<home:{_BOX},away:{_BOX}>"
VENUES = "map<string,struct<name:string,tz_id:string,offset:int>>"
DIRECTORY = "teams array<struct<id:bigint,name:string,abbreviation:string,venue:string,city:string,region:string>>"
OVERRIDES = "map<string,struct<venue:string,city:string,region:string>>"


def read_schedule(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Games of schedule files: one payload a file, or with `lines` one a line, which large files can be split by."""
    return parse_schedule(spark.read.schema(SCHEDULE).option("multiLine", not lines).json(path))


def read_boxscores(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested boxscores of files, for parse_pitchers and parse_batters; lines as in read_schedule."""
    return spark.read.schema(BOXSCORE).option("multiLine", not lines).json(path)


def parse_schedule(payloads: DataFrame) -> DataFrame:
    """One row per game of nested schedules (column dates); absent structs give nulls."""
    g = payloads.select(F.explode("dates").alias("d")).select(F.explode("d.games").alias("g"))
    side = lambda s: [F.col(f"g.teams.{s}.team.id").alias(f"{s}_team_id"), F.col(f"g.teams.{s}.team.name").alias(f"{s}_team_name"), F.col(f"g.teams.{s}.score").alias(f"{s}_score"), F.col(f"g.teams.{s}.leagueRecord.wins").alias(f"{s}_wins_after"), F.col(f"g.teams.{s}.leagueRecord.losses").alias(f"{s}_losses_after"), F.col(f"g.teams.{s}.probablePitcher.id").alias(f"{s}_probable_id")]
    rows = g.select(
        F.col("g.gamePk").alias("game_pk"), F.col("g.season").cast("int").alias("season"), F.col("g.officialDate").cast("date").alias("date"), F.try_to_timestamp("g.gameDate").alias("start_time_utc"), F.col("g.gameType").alias("game_type"),
        F.col("g.status.abstractGameState").alias("abstract_state"), F.col("g.status.detailedState").alias("detailed_state"), F.col("g.doubleHeader").alias("double_header"), F.col("g.gameNumber").alias("game_number"), F.col("g.rescheduledFrom").alias("rescheduled_from"),
        F.col("g.venue.id").alias("venue_id"), F.col("g.linescore.scheduledInnings").alias("scheduled_innings"), F.col("g.linescore.currentInning").alias("innings"), F.col("g.decisions.winner.id").alias("winning_pitcher_id"), F.col("g.decisions.loser.id").alias("losing_pitcher_id"),
        F.col("g.teams.home.isWinner").alias("home_is_winner_flag"), *side("home"), *side("away"),
    )
    rows = rows.withColumn("is_final", is_final(F.col("abstract_state"), F.col("detailed_state"))).withColumn("is_anomalous_season", is_anomalous_season(F.col("season")))
    return rows.withColumn("home_win", home_win())


def _sides(boxes: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"teams.{s}").alias("box")) for s in ("home", "away")])
    return boxes.select("game_pk", "winning_pitcher_id", "losing_pitcher_id", F.explode(both).alias("s")).select("game_pk", "winning_pitcher_id", "losing_pitcher_id", "s.side", "s.box")


def parse_pitchers(boxes: DataFrame) -> DataFrame:
    """One row per id of the ordered pitchers array, statistics looked up in the players map."""
    # the player is looked up before the rows are made, so that none of them carries the whole map
    found = lambda i, at: F.struct(at.alias("pos"), i.alias("pitcher_id"), F.col("box.players")[F.concat(F.lit("ID"), i)].alias("player"))
    rows = _sides(boxes).select("game_pk", "winning_pitcher_id", "losing_pitcher_id", "side", F.col("box.team.id").alias("team_id"), F.explode(F.transform("box.pitchers", found)).alias("x")).select("*", "x.*")
    rows = rows.withColumn("p", F.col("player.stats.pitching")).withColumn("name", F.col("player.person.fullName"))
    out = rows.select("game_pk", "side", "team_id", "pitcher_id", "name", (F.col("pos") + 1).alias("appearance_order"), (F.col("pos") == 0).alias("is_starter"), ip_to_outs(F.col("p.inningsPitched")).alias("ip_outs"), F.col("p.battersFaced").alias("batters_faced"), F.col("p.runs").alias("runs"), F.col("p.strikeOuts").alias("strikeouts"), F.col("p.baseOnBalls").alias("walks"), F.col("p.homeRuns").alias("home_runs"), F.col("p.hitByPitch").alias("hit_by_pitch"), decision(F.col("pitcher_id"), F.col("winning_pitcher_id"), F.col("losing_pitcher_id"), F.col("p.note")).alias("decision"))
    return out.withColumn("is_opener", is_opener(F.col("is_starter"), F.col("ip_outs"), F.col("batters_faced")))


def parse_batters(boxes: DataFrame) -> DataFrame:
    """One row per player with batting statistics or a batting order; slot = order div 100."""
    rows = _sides(boxes).select("game_pk", "side", F.col("box.team.id").alias("team_id"), F.explode(F.map_values("box.players")).alias("p"))
    rows = rows.filter("p.stats.batting is not null or p.battingOrder is not null")
    return rows.select("game_pk", "side", "team_id", F.col("p.person.id").alias("batter_id"), batting_slot(F.col("p.battingOrder")).alias("slot"), F.col("p.position.abbreviation").alias("position"), F.col("p.stats.batting.plateAppearances").alias("plate_appearances"), F.col("p.stats.batting.hits").alias("hits"), F.col("p.stats.batting.runs").alias("runs"))


def batting_slot(order: Column) -> Column:
    return F.floor(order.cast("int") / 100).cast("int")


def attach_meta(rows: DataFrame, games: DataFrame) -> DataFrame:
    return rows.join(games.select("game_pk", "season", "date", "game_type"), "game_pk", "left")


def missing_boxscores(games: DataFrame, rows: DataFrame) -> DataFrame:
    return games.select("game_pk").join(rows.select("game_pk"), "game_pk", "left_anti")


def read_games_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV: text booleans by name, nulls stay null."""
    fields = [f.split() for f in schema.split(", ")]
    raw = spark.read.option("header", True).schema(", ".join(f"{n} {'string' if t == 'boolean' else t}" for n, t in fields)).csv(path)
    return raw.select(*[text_boolean(F.col(n)).alias(n) if t == "boolean" else F.col(n) for n, t in fields])


def text_boolean(c: Column, null_is_false: bool = False) -> Column:
    out = F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    return F.coalesce(out, F.lit(False)) if null_is_false else out


def parse_venues(raw: DataFrame) -> DataFrame:
    """raw: json, a map of venue id -> struct."""
    return raw.select(F.explode(F.from_json("json", VENUES)).alias("id", "v")).select(F.col("id").cast("int").alias("venue_id"), "v.*")


def missing_dimension(facts: DataFrame, dimension: DataFrame, key: str = "venue_id") -> DataFrame:
    """Distinct keys of facts that the dimension lacks; must be empty."""
    return facts.select(key).filter(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def parse_directory(raw: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Teams of a JSON directory (raw: json), with overrides (json: map of team id -> fields) applied field by field."""
    schema = f"struct<{DIRECTORY.replace('teams ', 'teams:', 1)}>"
    rows = raw.select(F.explode(F.from_json("json", schema)["teams"]).alias("t")).select("t.*")
    if overrides is None:
        return rows
    o = overrides.select(F.explode(F.from_json("json", OVERRIDES)).alias("k", "o")).select(F.col("k").cast("long").alias("id"), *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("venue", "city", "region")])
    return rows.join(o, "id", "left").select("id", "name", "abbreviation", *[F.coalesce(f"o_{c}", c).alias(c) for c in ("venue", "city", "region")])


def search_directory(directory: DataFrame, words: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "name", "abbreviation", "venue", "city", "region"))
    return directory.filter(text.contains(words.lower()))


def official_standings(rows: DataFrame) -> DataFrame:
    """rows: team_id, league, division, division_rank, wildcard_rank, clinched, games_back -> status and order."""
    status = F.when(F.col("division_rank") == 1, "Division winner").when(F.col("wildcard_rank") <= 3, "Wild card").when(F.col("clinched"), "Clinched").otherwise("—")
    return rows.withColumn("status", status).withColumn("games_back", F.coalesce("games_back", F.lit("—"))).orderBy("league", "division", "division_rank", "team_id")
