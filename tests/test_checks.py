"""Percentiles, AUC and further audits against plain Python on small rows."""

import random

import numpy as np
import pytest

from asof_spark.operators import checks, metrics


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [0.0, 1e-9, 1.0, 5.0], [random.Random(3).gauss(0, 1) for _ in range(997)], [float(i % 7) for i in range(500)], [1e9, 1e9 + 1, -1e9, 0.1, 0.2]])
def test_percentiles(spark, values):
    at = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("none", None)], "name string, value double")
    got = metrics.percentiles(rows, at).collect()
    assert [r.name for r in got] == ["a"]
    assert got[0].q == pytest.approx(list(np.percentile(values, [100 * f for f in at])), abs=1e-6)


def plain_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_by_group(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(2), round(0.5 + rng.gauss(0, s), d)) for g, s, d in (("wide", 0.6, 6), ("narrow", 1e-7, 12), ("tied", 0.1, 1)) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("one class", 1, 0.2), (None, 1, 0.3), (None, 0, 0.1)], "g string, y int, p double")
    got = {r.g: r.auc for r in metrics.auc(df, "g").collect()}
    assert got.pop("one class") is None and got.pop(None) == 1.0
    assert got == pytest.approx({g: plain_auc([r[1:] for r in rows if r[0] == g]) for g in got})
    assert metrics.auc(df.filter("false"), "g").count() == 0 and metrics.auc(df.filter("false")).first().auc is None


def test_doubleheader_codes(spark):
    day = "date string, home_team_id int, away_team_id int, game_number int, doubleheader_code string, game_type string"
    rows = [("d1", 1, 2, 1, "S", "R"), ("d1", 1, 2, 2, "S", "R"), ("d2", 1, 2, 1, "N", "R"), ("d2", 1, 2, 2, "Y", "R"), ("d3", 1, 2, 1, "Y", "R"), ("d3", 1, 2, 1, "Y", "R"), ("d4", 1, 2, 1, None, "R"), ("d4", 1, 2, 2, "Y", "R"), ("d5", 1, 2, 1, "N", "S"), ("d5", 1, 2, 1, "N", "S")]
    got = {r.date: r.clean for r in checks.doubleheader_codes(spark.createDataFrame(rows, day)).collect()}
    assert got == {"d1": True, "d2": False, "d3": False, "d4": False}


def test_outs_exceptions(spark):
    games = [(1, 1, 9, 9), (2, 0, 9, 9), (3, None, 9, 9), (4, 1, 9, 6), (5, 0, 7, 7), (6, 0, None, None)]
    rows = [(g, home, 26) for g in range(1, 7) for home in (True, False)] + [(2, True, 1)]
    g = spark.createDataFrame(games, "game_pk int, home_win int, scheduled_innings int, innings_played int")
    got = {(r.is_home, r.reason): r.n for r in checks.outs_exceptions(g, spark.createDataFrame(rows, "game_pk int, is_home boolean, ip_outs int")).collect()}
    assert got == {(True, "unexplained"): 2, (False, "walk_off"): 1, (False, "unexplained"): 2, (True, "called"): 2, (False, "called"): 2}


def test_runs_both_ways_and_winner_nulls(spark):
    games = spark.createDataFrame([(1, 2000, True, 3, 1, 1), (2, 2000, True, 2, 2, None), (3, 2000, True, 4, 2, None), (4, 2000, True, 5, 5, 1)], "game_pk int, season int, is_final boolean, home_score int, away_score int, home_win int")
    sides = spark.createDataFrame([(1, True, 1, 3), (1, False, 3, 2), (2, True, None, 2)], "game_pk int, is_home boolean, allowed int, scored int")
    got = {(r.game_pk, r.is_home, r.kind): (r.logged, r.score) for r in checks.runs_both_ways(games, sides).collect()}
    assert got == {(1, False, "scored"): (2, 1), (2, True, "allowed"): (None, 2)}
    assert [tuple(r)[1:] for r in checks.winner_nulls(games).collect()] == [(4, 2, 1, 1)]


def test_containment_finds_a_window_without_the_first_game(spark):
    long = spark.createDataFrame([(1, 7, 2000, "a", 0), (2, 7, 2000, "a", 1), (3, 7, 2000, "b", 2)], "game_pk int, team_id int, season int, date string, ord int")
    keys = lambda k: spark.createDataFrame([(2, 7, "form_15", k)], "game_pk int, team_id int, feature string, keys array<int>")
    assert tuple(checks.doubleheader_containment(long, keys([1])).first()) == (1, 0)
    assert tuple(checks.doubleheader_containment(long, keys([])).first()) == (1, 1)
    late = spark.createDataFrame([("x", 5, 5), ("x", 5, 4), ("x", 0, None)], "feature string, ord int, last_ord int")
    assert [tuple(r) for r in checks.source_violations(late).collect()] == [("x", 3, 1)]
