"""Registered queries of the further audits (parts of sections D, K and L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from asof_spark.operators import asof, audits, checks

from .base import DIGITS, Base, sql
from .batch import _TEST, _TRAIN, query
from .scoring import split_of

# --- games ---------------------------------------------------------------------------------------------------

# The tables have no codes: the game's key gives one, and the week stands for the date, so that pairings repeat.
_CODE = "CASE WHEN game_pk % 7 = 0 THEN 'N' WHEN game_pk % 2 = 0 THEN 'S' ELSE 'Y' END"


@query(sql(f"""SELECT date, home_team_id, away_team_id, count(*) AS n, count(DISTINCT game_number) AS numbers, count(*) FILTER (code = 'N') AS other_codes, count(*) = count(DISTINCT game_number) AND count(*) FILTER (code = 'N') = 0 AS clean
  FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS date, home_team_id, away_team_id, game_number, {_CODE} AS code FROM games WHERE game_type = 'R') GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def k5_doubleheader_codes(b: Base):
    return checks.doubleheader_codes(b.games.withColumn("doubleheader_code", F.expr(_CODE)).withColumn("date", F.trunc("date", "week")))


@query(sql("SELECT season, count(*) AS n, count(*) FILTER (home_score = away_score) AS ties, 0::BIGINT AS unexplained, 0::BIGINT AS won_ties FROM games WHERE is_final GROUP BY 1"))
def k6_winner_nulls(b: Base):
    return checks.winner_nulls(b.games)


@query(sql("""SELECT status, explained, count(*) AS n FROM (SELECT CASE WHEN game_pk % 19 = 0 THEN 'only_left' WHEN game_pk % 29 = 0 THEN 'differs' END AS status, game_pk % 19 = 0 AND NOT is_final AS explained FROM games)
  WHERE status IS NOT NULL GROUP BY 1, 2"""))
def k8_explained_extras(b: Base):
    right = b.games.filter("game_pk % 19 <> 0").withColumn("home_score", F.when(F.col("game_pk") % 29 == 0, F.col("home_score") + 1).otherwise(F.col("home_score")))
    return checks.explained_extras(audits.reconcile(b.games, right, "game_pk", ("home_score", "venue_id")), b.games)


@query(sql("""SELECT team_id, count(*) AS games, min(date) AS first_date, max(date) AS last_date, count(*) < 162 AS ok
  FROM (SELECT date, CAST(unnest([home_team_id, away_team_id]) AS INT) AS team_id FROM played WHERE season = 2001) GROUP BY 1""", "played"))
def k9_team_spots(b: Base):
    return checks.team_spots(b.played, 2001)


# --- logs ----------------------------------------------------------------------------------------------------


@query(sql("""SELECT game_pk, is_home, coalesce(n, 0) AS n FROM (SELECT game_pk, unnest([TRUE, FALSE]) AS is_home FROM played) LEFT JOIN (SELECT game_pk, is_home, count(*) AS n FROM logs GROUP BY 1, 2) USING (game_pk, is_home)
  WHERE coalesce(n, 0) < 2""", "played", "logs"))
def l1_thin_sides(b: Base):
    """Sides with fewer than two rows: the tables have some four rows a game, so nine would list every side."""
    return checks.thin_sides(b.played, b.logs, 2)


_INNINGS = ("CASE WHEN game_pk % 10 = 0 THEN 7 WHEN game_pk % 13 <> 0 THEN 9 END", "CASE WHEN game_pk % 11 = 0 THEN 6 WHEN game_pk % 3 = 0 THEN 9 END")


@query(sql(f"""SELECT is_home, CASE WHEN called THEN 'called' WHEN NOT is_home AND home_win = 1 THEN 'walk_off' ELSE 'unexplained' END AS reason, count(*) AS n
  FROM (SELECT game_pk, is_home FROM logs GROUP BY 1, 2 HAVING sum(ip_outs) % 3 <> 0)
  JOIN (SELECT game_pk, home_win, coalesce({_INNINGS[1]}, 9) < 9 OR home_win IS NULL AS called FROM played WHERE coalesce({_INNINGS[0]}, 9) = 9) USING (game_pk) GROUP BY 1, 2""", "played", "logs"))
def l2_outs_exceptions(b: Base):
    return checks.outs_exceptions(b.played.withColumns({"scheduled_innings": F.expr(_INNINGS[0]), "innings_played": F.expr(_INNINGS[1])}), b.logs)


@query(sql("""SELECT game_pk, is_home, kind, logged, CAST(score AS BIGINT) AS score FROM (
  SELECT game_pk, is_home, unnest(['allowed', 'scored']) AS kind, unnest([s.allowed, s.scored]) AS logged, unnest(CASE WHEN is_home THEN [away_score, home_score] ELSE [home_score, away_score] END) AS score
  FROM (SELECT game_pk, is_home, CAST(sum(home_runs) AS BIGINT) AS allowed, CAST(sum(walks) AS BIGINT) AS scored FROM logs GROUP BY 1, 2) s JOIN played USING (game_pk)) WHERE logged IS DISTINCT FROM score""", "played", "logs"))
def l3_runs_both_ways(b: Base):
    """Home runs stand for runs allowed and walks for runs scored, which the tables lack."""
    return checks.runs_both_ways(b.played, b.logs.groupBy("game_pk", "is_home").agg(F.sum("home_runs").alias("allowed"), F.sum("walks").alias("scored")))


@query(sql("""SELECT a.faced - c.came AS difference, count(*) AS n FROM (SELECT game_pk, is_home, CAST(sum(batters_faced) AS BIGINT) AS faced FROM rows_ GROUP BY 1, 2) a
  JOIN (SELECT game_pk, NOT is_home AS is_home, CAST(sum(ip_outs + walks) AS BIGINT) AS came FROM rows_ GROUP BY 1, 2) c USING (game_pk, is_home) GROUP BY 1""", "rows"))
def l4_plate_appearances(b: Base):
    """Outs and walks of a row stand for a batter's plate appearances."""
    return checks.plate_appearances(b.rows, b.rows.withColumn("plate_appearances", F.col("ip_outs") + F.col("walks")))


_REQUIRED = ("game_pk", "pitcher_id", "is_home", "ip_outs", "batters_faced", "home_win", "venue_id")


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n, count(*) FILTER ({c} IS NULL) = 0 AS ok FROM (SELECT l.*, p.home_win, p.venue_id FROM logs l JOIN played p USING (game_pk))" for c in _REQUIRED), "played", "logs"))
def l7_required_columns(b: Base):
    return checks.required_columns(b.logs.join(b.played.select("game_pk", "home_win", "venue_id"), "game_pk"), _REQUIRED)


@query(sql(f"SELECT season, count(DISTINCT game_pk) AS games, count(*) AS n, round(count(*) / count(DISTINCT game_pk), {DIGITS}) AS per_game, count(*) / count(DISTINCT game_pk) BETWEEN 3.9 AND 4.1 AS ok FROM rows_ GROUP BY 1", "rows"))
def l7_row_band(b: Base):
    return checks.row_band(b.rows, 3.9, 4.1)


# --- sources of features -------------------------------------------------------------------------------------

_TEAM = """team_sources AS (SELECT game_pk, team_id, ord, unnest(['rest_days', 'tz_delta']) AS feature, unnest([CAST(rest IS NOT NULL AS BIGINT), CAST(zone IS NOT NULL AS BIGINT)]) AS games, unnest([rest, zone]) AS last_ord FROM (
    SELECT *, lag(ord) OVER (PARTITION BY team_id ORDER BY ord) AS rest, CASE WHEN off IS NOT NULL AND lag(off) OVER s IS NOT NULL THEN lag(ord) OVER s END AS zone FROM long LEFT JOIN venues USING (venue_id) WINDOW s AS (PARTITION BY team_id, season ORDER BY ord)))"""
_PITCHER = """placed AS (SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY ord) AS place, lag(ord) OVER (PARTITION BY pitcher_id ORDER BY ord) AS last_ord FROM cum),
  pitcher_sources AS (SELECT i.game_pk, i.pitcher_id, i.ord, 'own_window' AS feature, i.place - coalesce(j.place, 1) AS games, i.last_ord FROM placed i LEFT JOIN walked w ON w.game_pk = i.game_pk AND w.pitcher_id = i.pitcher_id LEFT JOIN placed j ON j.pitcher_id = i.pitcher_id AND j.ord = w.stop)"""
_LEAGUE = """starts AS (SELECT o.game_pk, o.date, o.ord, count(r.game_pk) AS n, CASE WHEN count(r.game_pk) > 0 THEN o.ord END AS spot FROM o LEFT JOIN rows_ r ON r.is_starter AND r.game_pk = o.game_pk GROUP BY 1, 2, 3),
  start_days AS (SELECT date, sum(n) OVER w AS n, max(spot) OVER w AS spot FROM (SELECT date, sum(n) AS n, max(spot) AS spot FROM starts GROUP BY 1) WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  league_sources AS (SELECT s.game_pk, s.ord, 'league_pool' AS feature, CAST(coalesce(d.n, 0) + coalesce(sum(s.n) OVER w, 0) AS BIGINT) AS games, coalesce(max(s.spot) OVER w, d.spot) AS last_ord
    FROM starts s JOIN start_days d USING (date) WINDOW w AS (PARTITION BY s.date ORDER BY s.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _with(ctes: str, body: str, *parts: str) -> str:
    return sql(body, *parts).replace("\n" + body, ",\n" + ctes + "\n" + body)


@query(_with(_TEAM, "SELECT * FROM team_sources", "long", "venues"))
def d23_team_sources(b: Base):
    return checks.team_sources(b.long, b.venues)


@query(_with(_PITCHER, "SELECT * FROM pitcher_sources", "cum"))
def d23_pitcher_sources(b: Base):
    return checks.pitcher_sources(b.rows)


@query(_with(_LEAGUE, "SELECT * FROM league_sources", "rows"))
def d23_league_sources(b: Base):
    return checks.league_sources(b.ordered, b.rows.filter("is_starter"))


_ALL = " UNION ALL ".join(f"SELECT feature, ord, last_ord FROM {t}" for t in ("team_sources", "pitcher_sources", "league_sources"))


@query(_with(f"{_TEAM},\n{_PITCHER},\n{_LEAGUE}", f"SELECT feature, count(*) AS checked, count(*) FILTER (last_ord >= ord) AS violations FROM ({_ALL}) GROUP BY 1", "long", "venues", "cum"))
def l16_all_sources(b: Base):
    return checks.source_violations(checks.team_sources(b.long, b.venues), checks.pitcher_sources(b.rows), checks.league_sources(b.ordered, b.rows.filter("is_starter")))


@query(sql("SELECT count(*) AS checked, 0::BIGINT AS missing FROM (SELECT date, lag(date) OVER (PARTITION BY team_id, season ORDER BY ord) AS before FROM long) WHERE date = before", "long"))
def l16_doubleheader_containment(b: Base):
    return checks.doubleheader_containment(b.long, asof.provenance(b.long))


@query()
def l13_shuffled_refit(b: Base):
    return checks.shuffled_refit(split_of(b, _TRAIN), split_of(b, _TEST))
