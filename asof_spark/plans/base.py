"""Frames that the registered queries start from, and the same tables as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asof_spark.operators import asof, ratings, readers, splits
from asof_spark.operators.audits import FEATURES
from asof_spark.sources import sinks, tables

DIGITS = 7


class Base:
    """games, played (regular-season finals), ordered and rows (logs of played games), both written once, logs, venues, teams, ratings, features."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.games = tables.games(spark, sf_dir)
        self.played = readers.load_games(self.games, matchups_only=False)
        self.venues, self.teams, self.ratings = tables.venues(self.games), tables.teams(self.games), tables.ratings(self.games)

    @cached_property
    def ordered(self) -> DataFrame:
        return sinks.cut(asof.canonical_order(self.played), "ordered")

    @property
    def logs(self) -> DataFrame:
        return tables.pitcher_logs(self.spark, self.sf_dir)

    @cached_property
    def rows(self) -> DataFrame:
        return sinks.cut(asof.log_rows(self.logs, self.ordered), "rows")

    @property
    def long(self) -> DataFrame:
        return asof.team_long(self.ordered)

    @property
    def features(self) -> DataFrame:
        return asof.build_features(self.played, self.logs, self.venues, burn_in_end=F.lit("1995-03-01").cast("date"))

    @property
    def eval_rows(self) -> DataFrame:
        return splits.eval_rows(self.features)

    @property
    def scored(self) -> DataFrame:
        """game_pk, season, date, home_win (decided games), elo and constant probabilities, y and p."""
        rows = ratings.score_snapshot(self.played.filter("home_win is not null"), self.ratings)
        return rows.select("game_pk", "season", "date", "home_win", F.round("elo_prob_home", 12).alias("elo"), F.lit(0.54).alias("constant"), (F.col("game_pk") % 3 == 0).alias("low_confidence"), F.col("home_win").alias("y"), F.round("elo_prob_home", 12).alias("p"))

    @property
    def log(self) -> DataFrame:
        from asof_spark.operators import predlog

        return predlog.score_slate(self.games, self.ratings, F.lit(None).cast("date"))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


GAMES = """games AS (SELECT *, CASE WHEN is_final AND home_score <> away_score THEN CAST(home_score > away_score AS INT) END AS home_win FROM (
  SELECT o_orderkey AS game_pk, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS date,
    CAST(o_orderkey % 24 AS INT) AS start_hour, CAST(1 + o_orderkey % 2 AS INT) AS game_number,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'W' WHEN '5-LOW' THEN 'S' ELSE 'R' END AS game_type,
    o_orderstatus <> 'P' AS is_final, CAST(o_custkey % 30 AS INT) AS home_team_id,
    CAST((o_custkey + 1 + o_orderkey % 29) % 30 AS INT) AS away_team_id,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 10 AS INT) AS home_score,
    CAST(CAST(floor(o_totalprice / 10) AS BIGINT) % 10 AS INT) AS away_score,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_custkey % 30 AS INT) END AS venue_id FROM orders))"""
PARTS = {
    "games": GAMES,
    "played": "played AS (SELECT * FROM games WHERE game_type = 'R' AND is_final AND season <> 2020)",
    "o": "o AS (SELECT *, row_number() OVER (ORDER BY date, game_number, game_pk) - 1 AS ord FROM played)",
    "long": """long AS (
      SELECT game_pk, season, date, ord, venue_id, home_team_id AS team_id, 'home' AS side, home_win AS won, home_score - away_score AS run_diff FROM o UNION ALL
      SELECT game_pk, season, date, ord, venue_id, away_team_id, 'away', 1 - home_win, away_score - home_score FROM o)""",
    "logs": """logs AS (SELECT *, ip_outs + home_runs + walks + hit_by_pitch + 1 AS batters_faced, pitcher_id = min(pitcher_id) OVER (PARTITION BY game_pk, is_home) AS is_starter FROM (
      SELECT l_orderkey AS game_pk, l_suppkey AS pitcher_id, l_suppkey % 2 = 0 AS is_home, CAST(sum(l_quantity) AS BIGINT) % 28 AS ip_outs,
        CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS home_runs, CAST(sum(l_linenumber) AS BIGINT) % 5 AS walks,
        CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS hit_by_pitch, CAST(sum(l_quantity) AS BIGINT) % 11 AS strikeouts
      FROM lineitem GROUP BY l_orderkey, l_suppkey))""",
    "rows": "rows_ AS (SELECT l.*, o.season, o.date, o.ord, CASE WHEN l.is_home THEN o.home_team_id ELSE o.away_team_id END AS team_id FROM logs l JOIN o USING (game_pk))",
    "venues": "venues AS (SELECT DISTINCT venue_id, CAST(-4 - venue_id % 4 AS INT) AS off FROM games WHERE venue_id IS NOT NULL)",
    "ratings": "ratings AS (SELECT DISTINCT team_id, CAST(1500 + (team_id * 7) % 90 - 45 AS DOUBLE) AS rating FROM (SELECT home_team_id AS team_id FROM games UNION SELECT away_team_id FROM games) WHERE team_id < 29)",
    "scored": """rated AS (SELECT g.*, coalesce(h.rating, 1500) AS hr, coalesce(a.rating, 1500) AS ar FROM games g LEFT JOIN ratings h ON h.team_id = g.home_team_id LEFT JOIN ratings a ON a.team_id = g.away_team_id),
      slate AS (SELECT *, round(1 / (1 + pow(10, -(hr + 25 - ar) / 400)), 12) AS elo FROM rated WHERE game_type = 'R'),
      scored AS (SELECT game_pk, season, date, home_win, elo, 0.54 AS constant, game_pk % 3 = 0 AS low_confidence, home_win AS y, elo AS p FROM slate WHERE is_final AND home_win IS NOT NULL)""",
    "form": """form AS (SELECT *, CASE WHEN count(won) OVER w >= 5 THEN CAST(sum(won) OVER w AS DOUBLE) / count(won) OVER w END AS form_15,
        CAST(row_number() OVER s - 1 AS INT) AS games_played,
        CASE WHEN row_number() OVER s > 5 THEN CAST(sum(run_diff) OVER u AS DOUBLE) / (row_number() OVER s - 1) END AS run_diff_pg,
        CAST(coalesce(least(date_diff('day', lag(date) OVER t, date), 5), 5) AS INT) AS rest_days
      FROM long WINDOW w AS (PARTITION BY team_id, season ORDER BY ord ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY team_id, season ORDER BY ord),
        u AS (PARTITION BY team_id, season ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY team_id ORDER BY ord))""",
    "tz": """tz AS (SELECT game_pk, team_id, side, CASE WHEN off IS NOT NULL THEN coalesce(abs(off - lag(off) OVER (PARTITION BY team_id, season ORDER BY ord)), 0) END AS tz_delta, off,
        lag(off) OVER (PARTITION BY team_id, season ORDER BY ord) AS off_before FROM long LEFT JOIN venues USING (venue_id))""",
    "cum": """cum AS (SELECT *, coalesce(sum(ip_outs) OVER w, 0) AS b_o, coalesce(sum(home_runs) OVER w, 0) AS b_hr, coalesce(sum(walks) OVER w, 0) AS b_bb, coalesce(sum(hit_by_pitch) OVER w, 0) AS b_hb, coalesce(sum(strikeouts) OVER w, 0) AS b_k, coalesce(sum(batters_faced) OVER w, 0) AS b_bf
        FROM rows_ WINDOW w AS (PARTITION BY pitcher_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      walked AS (SELECT i.game_pk, i.pitcher_id, max(j.ord) AS stop FROM cum i JOIN cum j ON j.pitcher_id = i.pitcher_id AND j.ord < i.ord AND i.b_o - j.b_o >= 180 GROUP BY 1, 2),
      win AS (SELECT i.game_pk, i.pitcher_id, i.is_home, i.is_starter, i.b_o >= 180 AS enough, i.b_o - coalesce(j.b_o, 0) AS outs, i.b_hr - coalesce(j.b_hr, 0) AS hr, i.b_bb - coalesce(j.b_bb, 0) AS bb, i.b_hb - coalesce(j.b_hb, 0) AS hb, i.b_k - coalesce(j.b_k, 0) AS k, i.b_bf - coalesce(j.b_bf, 0) AS bf
        FROM cum i LEFT JOIN walked w ON w.game_pk = i.game_pk AND w.pitcher_id = i.pitcher_id LEFT JOIN cum j ON j.pitcher_id = i.pitcher_id AND j.ord = w.stop),
      own AS (SELECT game_pk, pitcher_id, is_home, is_starter, enough, CAST(outs AS BIGINT) AS own_outs, CASE WHEN outs > 0 THEN CAST(13 * hr + 3 * (bb + hb) - 2 * k AS DOUBLE) / (outs / 3.0) END AS own_fip, CASE WHEN bf > 0 THEN CAST(k AS DOUBLE) / bf END AS own_k FROM win)""",
    "league": """counts AS (SELECT g.game_pk, g.date, g.ord, coalesce(sum(ip_outs), 0) AS o, coalesce(sum(home_runs), 0) AS hr, coalesce(sum(walks), 0) + coalesce(sum(hit_by_pitch), 0) AS bb, coalesce(sum(strikeouts), 0) AS k, coalesce(sum(batters_faced), 0) AS bf
        FROM o g LEFT JOIN rows_ r ON r.is_starter AND r.game_pk = g.game_pk GROUP BY 1, 2, 3),
      days AS (SELECT date, sum(o) OVER w AS o, sum(hr) OVER w AS hr, sum(bb) OVER w AS bb, sum(k) OVER w AS k, sum(bf) OVER w AS bf
        FROM (SELECT date, sum(o) AS o, sum(hr) AS hr, sum(bb) AS bb, sum(k) AS k, sum(bf) AS bf FROM counts GROUP BY 1)
        WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
      pooled AS (SELECT c.game_pk, coalesce(d.o, 0) + coalesce(sum(c.o) OVER w, 0) AS o, coalesce(d.hr, 0) + coalesce(sum(c.hr) OVER w, 0) AS hr, coalesce(d.bb, 0) + coalesce(sum(c.bb) OVER w, 0) AS bb,
          coalesce(d.k, 0) + coalesce(sum(c.k) OVER w, 0) AS k, coalesce(d.bf, 0) + coalesce(sum(c.bf) OVER w, 0) AS bf
        FROM counts c JOIN days d USING (date) WINDOW w AS (PARTITION BY c.date ORDER BY c.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      league AS (SELECT game_pk, CASE WHEN o > 0 THEN CAST(13 * hr + 3 * bb - 2 * k AS DOUBLE) / (o / 3.0) END AS league_fip, CASE WHEN bf > 0 THEN CAST(k AS DOUBLE) / bf END AS league_k FROM pooled)""",
    "park": """park AS (SELECT s.season, v.venue_id, (CAST(sum(v.runs) AS DOUBLE) / sum(v.n)) / any_value(l.rate) AS park_factor FROM (SELECT DISTINCT season FROM o) s
        JOIN (SELECT season, venue_id, sum(home_score + away_score) AS runs, count(*) AS n FROM o WHERE venue_id IS NOT NULL AND season <> 2020 GROUP BY 1, 2) v ON v.season BETWEEN s.season - 3 AND s.season - 1
        JOIN (SELECT s2.season, CAST(sum(home_score + away_score) AS DOUBLE) / count(*) AS rate FROM (SELECT DISTINCT season FROM o) s2 JOIN o ON o.season BETWEEN s2.season - 3 AND s2.season - 1 AND o.venue_id IS NOT NULL AND o.season <> 2020 GROUP BY 1) l ON l.season = s.season
      GROUP BY 1, 2)""",
    "starter": """starter AS (SELECT g.game_pk, s.side, w.pitcher_id, CASE WHEN w.enough THEN own_fip ELSE league_fip END AS fip, CASE WHEN w.enough THEN own_k ELSE league_k END AS k, coalesce(own_outs, 0) / 3.0 AS trailing_ip, NOT coalesce(w.enough, FALSE) AS low_confidence
      FROM o g CROSS JOIN (SELECT unnest(['home', 'away']) AS side) s LEFT JOIN own w ON w.game_pk = g.game_pk AND w.is_starter AND w.is_home = (s.side = 'home') JOIN league l ON l.game_pk = g.game_pk)""",
    "features": """features AS (SELECT o.game_pk, o.season, o.date, o.game_number, o.ord, o.home_team_id, o.away_team_id, o.home_win, h.form_15 AS home_form_15, a.form_15 AS away_form_15, h.run_diff_pg AS home_run_diff_pg, a.run_diff_pg AS away_run_diff_pg,
        h.rest_days AS home_rest_days, a.rest_days AS away_rest_days, z.tz_delta AS away_tz_delta, hs.fip AS home_sp_fip, aw.fip AS away_sp_fip, hs.k AS home_sp_k_rate, aw.k AS away_sp_k_rate, coalesce(p.park_factor, 1.0) AS park_factor,
        h.games_played AS home_games_played, a.games_played AS away_games_played, h.games_played < 15 AS home_form_low_confidence, a.games_played < 15 AS away_form_low_confidence, hs.trailing_ip AS home_sp_trailing_ip, aw.trailing_ip AS away_sp_trailing_ip,
        hs.low_confidence AS home_sp_low_confidence, aw.low_confidence AS away_sp_low_confidence, p.park_factor IS NULL AS park_factor_imputed, o.date < DATE '1995-03-01' AS is_burn_in
      FROM o JOIN form h ON h.game_pk = o.game_pk AND h.side = 'home' JOIN form a ON a.game_pk = o.game_pk AND a.side = 'away' JOIN tz z ON z.game_pk = o.game_pk AND z.side = 'away'
        JOIN starter hs ON hs.game_pk = o.game_pk AND hs.side = 'home' JOIN starter aw ON aw.game_pk = o.game_pk AND aw.side = 'away' LEFT JOIN park p ON p.season = o.season AND p.venue_id = o.venue_id)""",
    "wl": "wl AS (SELECT season, game_pk, CASE WHEN home_score > away_score THEN home_team_id ELSE away_team_id END AS winner, CASE WHEN home_score > away_score THEN away_team_id ELSE home_team_id END AS loser FROM played)",
}
NEEDS = {"played": ["games"], "o": ["played"], "long": ["o"], "rows": ["logs", "o"], "venues": ["games"], "ratings": ["games"], "scored": ["ratings"], "form": ["long"], "tz": ["long", "venues"], "cum": ["rows"], "league": ["rows"], "park": ["o"], "starter": ["cum", "league"], "features": ["form", "tz", "starter", "park"], "wl": ["played"]}


def sql(body: str, *parts: str) -> str:
    """body after the common tables that it names, with all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for p in parts or ("games",):
        need(p)
    return "WITH " + ",\n".join(PARTS[p] for p in order) + "\n" + body


def replay_sql(body: str, order: str, games: str = "played", pool: str = "0", won: str = "home_win", margin: bool = False) -> str:
    """body over chain (pool, n, game_pk, season, h, a, ratings before the game, state after it; teams count from 1), one step a game."""
    weight = "ln(abs(diff) + 1) * 2.2 / ((CASE WHEN won = 1 THEN home_elo - away_elo ELSE away_elo - home_elo END) * 0.001 + 2.2)" if margin else "1.0"
    return sql(
        f"""line AS (SELECT {pool} AS pool, game_pk, season, home_win, home_team_id + 1 AS h, away_team_id + 1 AS a, {won} AS won, CAST(home_score - away_score AS DOUBLE) AS diff, row_number() OVER (PARTITION BY {pool} ORDER BY {order}) AS n FROM {games}),
      chain AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS game_pk, NULL::INT AS season, NULL::INT AS h, NULL::INT AS a, NULL::DOUBLE AS home_elo, NULL::DOUBLE AS away_elo, list_transform(range(30), lambda x: 1500.0::DOUBLE) AS state FROM (SELECT DISTINCT pool FROM line)
        UNION ALL SELECT pool, n, game_pk, season, h, a, home_elo, away_elo, list_transform(st, lambda x, i: CASE i WHEN h THEN x + change WHEN a THEN x - change ELSE x END)
        FROM (SELECT *, CASE WHEN won IS NULL THEN 0.0 ELSE 4.0::DOUBLE * {weight} * (won - 1 / (1 + pow(10, -(home_elo + 25 - away_elo) / 400))) END AS change
        FROM (SELECT *, st[h] AS home_elo, st[a] AS away_elo
        FROM (SELECT l.pool, l.n, l.game_pk, l.season, l.h, l.a, l.won, l.diff, CASE WHEN l.season <> c.season THEN list_transform(c.state, lambda x: x + (1500 - x) * (1.0::DOUBLE / 3)) ELSE c.state END AS st
        FROM chain c JOIN line l ON l.pool = c.pool AND l.n = c.n + 1))))
{body}""", "played"
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("\nline AS", ",\nline AS", 1)


def r(column: str, name: str | None = None) -> str:
    return f"round({column}, {DIGITS}) AS {name or column}"


FEATURE_SQL = ", ".join(r(c) for c in (*FEATURES, "home_sp_trailing_ip", "away_sp_trailing_ip"))
