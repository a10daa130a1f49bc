"""Registered queries of the features by definition and of what they rest on (sections D and L)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asof_spark.operators import asof, audits, definition

from .base import FEATURE_SQL, Base, sql
from .batch import query

_FLAGS = ("home_games_played", "away_games_played", "home_form_low_confidence", "away_form_low_confidence", "home_sp_low_confidence", "away_sp_low_confidence", "park_factor_imputed")
_RECOMPUTED = (*audits.FEATURES, "home_sp_trailing_ip", "away_sp_trailing_ip", *_FLAGS)


@query(sql(f"SELECT game_pk, {FEATURE_SQL}, {', '.join(_FLAGS)} FROM features", "features"))
def l14_recompute_all(b: Base):
    return definition.recompute(b.ordered, b.rows, b.venues).select("game_pk", *_RECOMPUTED)


@query(sql("SELECT count(*) AS games, 0::BIGINT AS differing FROM o", "o"))
def l14_differing(b: Base):
    """Games whose stored features are not those of the definition; a test plants one."""
    stored = asof.features_of(b.ordered, b.rows, b.venues)
    bad = audits.differing(stored, definition.recompute(b.ordered, b.rows, b.venues), ("game_pk",), _RECOMPUTED)
    return stored.agg(F.count(F.lit(1)).alias("games")).join(bad.agg(F.count(F.lit(1)).alias("differing")))


# Lists by comparisons of positions; the walk back of a starter is that of the windows' SQL (stop: the last row with 180 outs from it on).
_LISTS = """asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ord) AS first FROM o) WHERE first = 1),
  sides AS (SELECT l.* FROM long l JOIN asked USING (game_pk)),
  season_before AS (SELECT s.game_pk, s.side, s.ord, j.game_pk AS pk, j.ord AS at_ord, row_number() OVER (PARTITION BY s.game_pk, s.side ORDER BY j.ord DESC) AS back
    FROM sides s JOIN long j ON j.team_id = s.team_id AND j.season = s.season AND j.ord < s.ord),
  rest AS (SELECT s.game_pk, s.side, max(j.ord) AS at_ord, arg_max(j.game_pk, j.ord) AS pk FROM sides s JOIN long j ON j.team_id = s.team_id AND j.ord < s.ord GROUP BY 1, 2),
  team_lists AS (SELECT game_pk, side, 'form_15' AS feature, count(*) AS games, max(at_ord) AS last_ord, string_agg(pk::VARCHAR, ',' ORDER BY at_ord) AS keys FROM season_before WHERE back <= 15 GROUP BY 1, 2
    UNION ALL SELECT game_pk, side, 'run_diff_pg', count(*), max(at_ord), string_agg(pk::VARCHAR, ',' ORDER BY at_ord) FROM season_before GROUP BY 1, 2
    UNION ALL SELECT game_pk, side, 'rest_days', 1, at_ord, pk::VARCHAR FROM rest
    UNION ALL SELECT game_pk, side, 'tz_delta', 1, at_ord, pk::VARCHAR FROM season_before WHERE back = 1),
  team_rows AS (SELECT s.game_pk, s.side, f.feature, s.ord, coalesce(t.games, 0) AS games, t.last_ord, coalesce(t.keys, '') AS keys, FALSE AS fallback
    FROM sides s CROSS JOIN (SELECT unnest(['form_15', 'run_diff_pg', 'rest_days', 'tz_delta']) AS feature) f LEFT JOIN team_lists t ON t.game_pk = s.game_pk AND t.side = s.side AND t.feature = f.feature
    WHERE f.feature <> 'tz_delta' OR s.side = 'away'),
  probes AS (SELECT a.game_pk, s.side, a.date, a.ord, c.pitcher_id, coalesce(c.b_o, 0) AS b_o, coalesce(w.stop, -1) AS stop
    FROM asked a CROSS JOIN (SELECT unnest(['home', 'away']) AS side) s LEFT JOIN cum c ON c.game_pk = a.game_pk AND c.is_starter AND c.is_home = (s.side = 'home') LEFT JOIN walked w ON w.game_pk = c.game_pk AND w.pitcher_id = c.pitcher_id),
  own_lists AS (SELECT p.game_pk, p.side, count(*) AS games, max(j.ord) AS last_ord, string_agg(j.game_pk::VARCHAR, ',' ORDER BY j.ord) AS keys
    FROM probes p JOIN rows_ j ON j.pitcher_id = p.pitcher_id AND j.ord < p.ord AND j.ord >= p.stop WHERE p.b_o >= 180 GROUP BY 1, 2),
  league_lists AS (SELECT a.game_pk, count(j.ord) AS games, max(j.ord) AS last_ord FROM asked a LEFT JOIN rows_ j ON j.is_starter AND j.ord < a.ord AND j.date >= a.date - 365 GROUP BY 1),
  pitch_rows AS (SELECT p.game_pk, p.side, f.feature, p.ord, CASE WHEN p.b_o >= 180 THEN w.games ELSE l.games END AS games, CASE WHEN p.b_o >= 180 THEN w.last_ord ELSE l.last_ord END AS last_ord,
    CASE WHEN p.b_o >= 180 THEN w.keys END AS keys, p.b_o < 180 AS fallback
    FROM probes p CROSS JOIN (SELECT unnest(['sp_fip', 'sp_k_rate']) AS feature) f LEFT JOIN own_lists w ON w.game_pk = p.game_pk AND w.side = p.side JOIN league_lists l ON l.game_pk = p.game_pk)"""
_BODY = "SELECT * FROM team_rows UNION ALL SELECT * FROM pitch_rows"


@query(sql(_BODY, "long", "cum").replace("\n" + _BODY, ",\n" + _LISTS + "\n" + _BODY))
def d23_requested_keys(b: Base):
    """Sources of the first game of every day; the keys as one text."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("ord"))
    asked = b.ordered.select("game_pk", place.alias("first")).filter("first = 1")
    return definition.provenance_of(b.ordered, b.rows, asked).withColumn("keys", F.array_join("keys", ","))
