"""Rules that are easy to get wrong, on small frames."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from asof_spark.functions import scalars
from asof_spark.operators import asof, audits, metrics, models, normalize, predlog, ratings, standings
from asof_spark.sources import payloads

GAMES = "game_pk long, season int, date date, game_number int, home_team_id int, away_team_id int, home_score int, away_score int, venue_id int, is_final boolean"


def games(spark, rows):
    return spark.createDataFrame([(i + 1, s, pd.Timestamp(d).date(), n, h, a, hs, as_, v, True) for i, (s, d, n, h, a, hs, as_, v) in enumerate(rows)], GAMES).withColumn("home_win", normalize.home_win())


def test_innings(spark):
    cases = {"0.0": 0, "0.1": 1, "0.2": 2, "1.0": 3, "6.1": 19, "9.0": 27, "2.2": 8, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert [r[0] for r in df.select(scalars.ip_to_outs(F.col("ip"))).collect()] == list(cases.values())
    with pytest.raises(Exception, match="not innings"):
        spark.createDataFrame([("6.4",)], "ip string").select(scalars.ip_to_outs(F.col("ip"))).collect()


def test_tie_is_null_and_counts_as_home_loss_in_records(spark):
    g = games(spark, [(2001, "2001-04-01", 1, 1, 2, 3, 3, 1), (2001, "2001-04-02", 1, 1, 2, 4, 1, 1)])
    assert [r[0] for r in g.orderBy("game_pk").select("home_win").collect()] == [None, 1]
    rec = {r["team_id"]: (r["wins"], r["losses"]) for r in standings.records(standings.winner_loser(g)).collect()}
    assert rec == {1: (1, 1), 2: (1, 1)}


def test_snapshot_without_start_wins_and_order_of_ingest_breaks_ties(spark):
    rows = [(1, True, 1, 0, "2001-01-02 00:00:00", 1), (1, True, 1, 0, None, 2), (1, False, None, None, "2002-01-01 00:00:00", 3), (2, True, 5, 0, "2001-01-01 00:00:00", 1), (2, True, 6, 0, "2001-01-01 00:00:00", 2)]
    df = spark.createDataFrame(rows, "game_pk long, is_final boolean, home_score int, away_score int, start_time_utc string, ingest_seq int")
    out = {r["game_pk"]: r["ingest_seq"] for r in normalize.dedupe_snapshots(df).collect()}
    assert out == {1: 2, 2: 2}


def test_time_zone_after_unknown_venue_is_zero_and_unknown_is_null(spark):
    g = games(spark, [(2001, f"2001-04-0{i}", 1, 9, 1, 2, 1, v) for i, v in enumerate([1, None, 2, 1], 1)])
    venues = spark.createDataFrame([(1, -5), (2, -8)], "venue_id int, offset int")
    rows = asof.tz_delta(asof.team_long(asof.canonical_order(g)), venues).filter("team_id = 1").orderBy("ord")
    assert [r["tz_delta"] for r in rows.collect()] == [0, None, 0, 3]


def test_window_keeps_partial_outs_but_takes_league_rates(spark):
    g = asof.canonical_order(games(spark, [(2001, f"2001-04-{i:02d}", 1, 1, 2, 2, 1, 1) for i in range(1, 13)]))
    logs = spark.createDataFrame([(i, p, p % 2 == 0, 18, 1, 1, 0, 5, 24, True) for i in range(1, 13) for p in (10, 11)], "game_pk long, pitcher_id long, is_home boolean, ip_outs long, home_runs long, walks long, hit_by_pitch long, strikeouts long, batters_faced long, is_starter boolean")
    rows = {r["game_pk"]: r for r in asof.starter_features(g, asof.log_rows(logs, g)).filter("side = 'home'").collect()}
    assert rows[1]["fip"] is None and rows[1]["low_confidence"] and rows[1]["trailing_ip"] == 0
    assert rows[10]["low_confidence"] and rows[10]["trailing_ip"] == pytest.approx(54.0)
    assert not rows[11]["low_confidence"] and rows[11]["trailing_ip"] == pytest.approx(60.0) and rows[12]["trailing_ip"] == pytest.approx(60.0)


def test_future_deletion_and_order(spark):
    g = games(spark, [(2001, f"2001-04-{1 + i // 2:02d}", 1 + i % 2, i % 4, (i + 1) % 4, i * 7 % 5, i * 3 % 4, i % 3) for i in range(40)])
    long = asof.team_long(asof.canonical_order(g))
    whole = asof.run_diff_pg(asof.form(long))
    part = asof.run_diff_pg(asof.form(long.filter("ord <= 25")))
    assert audits.differing(part, whole, ("game_pk", "team_id"), ("form_15", "run_diff_pg")).count() == 0
    assert audits.order_violations(asof.provenance(long)).count() == 0
    by_definition = audits.recompute_form(asof.canonical_order(g), g.select("game_pk"))
    assert audits.differing(whole, by_definition, ("game_pk", "team_id"), ("form_15", "run_diff_pg")).count() == 0


def test_elo_replay_equals_a_plain_loop(spark):
    g = games(spark, [(1999 + i // 20, f"{1999 + i // 20}-05-{1 + i % 20:02d}", 1, i % 5, (i + 1 + i % 3) % 5, i * 7 % 6, i * 5 % 6, 1) for i in range(60)]).withColumns({"pool": F.lit(0), "start_hour": F.lit(1)})
    got = {r["game_pk"]: r["elo_prob_home"] for r in ratings.replay_elo(g, "pool").collect()}
    state, season = {}, None
    for r in g.orderBy("date", "start_hour", "game_pk").collect():
        if season is not None and r.season != season:
            state = {t: x + (1500 - x) / 3 for t, x in state.items()}
        season = r.season
        h, a = state.get(r.home_team_id, 1500.0), state.get(r.away_team_id, 1500.0)
        p = 1 / (1 + 10 ** (-(h + 25 - a) / 400))
        assert got[r.game_pk] == pytest.approx(p, abs=1e-12)
        state[r.home_team_id], state[r.away_team_id] = h, a
        if r.home_win is not None:
            state[r.home_team_id], state[r.away_team_id] = h + 4 * (r.home_win - p), a - 4 * (r.home_win - p)


def test_series_anchors(spark):
    one = spark.range(1).select(*[F.aggregate(scalars.series_lengths(f"array_repeat({p}D, {n})", n), F.lit(0.0), lambda s, x: s + x).alias(f"x{n}") for p, n in ((0.55, 3), (0.55, 7), (0.6, 5))]).first()
    assert one.x3 == pytest.approx(0.57475, abs=1e-5) and one.x7 == pytest.approx(0.60829, abs=1e-5)
    assert one.x5 == pytest.approx(sum(math.comb(2 + k, k) * 0.6**3 * 0.4**k for k in range(3)), abs=1e-9)


def test_metric_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 1.0), (0, 0.3)], "y int, p double")
    assert metrics.evaluate(df).first()["accuracy"] == 0.75 and metrics.evaluate(df, at_half=True).first()["accuracy"] == 0.75
    assert metrics.auc(df).first()[0] == pytest.approx(0.875)
    assert metrics.auc(df.withColumn("p", F.lit(0.4))).first()[0] is None
    rel = {r["bin"]: r["n"] for r in metrics.reliability(df).collect()}
    assert rel[9] == 1 and rel[2] == 1 and rel[5] == 2 and rel[0] == 0  # 0.3 is below the edge 0.30000000000000004


def test_log_is_idempotent_and_settles(spark):
    log = spark.createDataFrame([(pd.Timestamp("2001-05-01").date(), i, 1, 2, p, 0.54, None) for i, p in ((1, 0.6), (2, 0.5), (3, 0.4))], "date date, game_id long, home_id int, away_id int, elo_prob_home double, baseline_prob_home double, home_won int")
    assert predlog.log_predictions(log, log).count() == 3
    settled = predlog.settle(log, spark.createDataFrame([(1, 1), (2, 0)], "game_pk long, home_win int"))
    r = predlog.score_latest_day(settled).first()
    assert (r.correct, r.total, r.pushes, r.pending, r.status) == (1, 1, 1, 1, "ok")
    assert predlog.score_latest_day(log).first()["status"] == "pending" and predlog.score_latest_day(log.limit(0)).first()["status"] == "no_log"


def test_schedule_file(spark, tmp_path):
    side = lambda i, s: {"team": {"id": i, "name": f"T{i}"}, "score": s}
    g = {"gamePk": 7, "season": "2016", "officialDate": "2016-08-20", "gameDate": "2016-08-21T00:10:00Z", "gameType": "R", "status": {"abstractGameState": "Final", "detailedState": "Final"}, "teams": {"home": side(1, 3), "away": side(2, 4)}}
    late = dict(g, gamePk=8, status={"abstractGameState": "Final", "detailedState": "Postponed"})
    (tmp_path / "s.json").write_text(json.dumps({"dates": [{"date": "2016-08-20", "games": [g, late]}]}))
    rows = {r["game_pk"]: r for r in payloads.read_schedule(spark, str(tmp_path)).collect()}
    assert str(rows[7]["date"]) == "2016-08-20" and rows[7]["home_win"] == 0 and rows[7]["venue_id"] is None
    assert not rows[8]["is_final"] and rows[8]["home_win"] is None


def test_model_seam_checks_range(spark):
    df = spark.range(5).withColumnRenamed("id", "game_pk").withColumn("x", F.lit(0.5))
    assert models.score_with(df, ("x",), lambda b: b["x"]).count() == 5
    with pytest.raises(Exception, match="must lie in"):
        models.score_with(df, ("x",), lambda b: b["x"] * 2).collect()


def test_shuffled_labels_are_a_permutation(spark):
    rows = spark.range(300).select(F.col("id").alias("game_pk"), (F.col("id") % 3 == 0).cast("int").alias("home_win"))
    out = audits.shuffled_labels(rows)
    assert out.count() == 300 and out.select("game_pk").distinct().count() == 300 and out.agg(F.sum("home_win")).first()[0] == 100
