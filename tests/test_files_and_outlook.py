"""File sources, names, bands, pairs and the model seam on small rows."""

import json
import os
from itertools import permutations

import pandas as pd
import pytest

from asof_spark.operators import metrics, models, ratings, standings
from asof_spark.plans import outlook, registry, scoring
from asof_spark.plans.base import Base
from asof_spark.sources import payloads
from asof_spark.streaming import refresh

SF = "/root/testdata/sf0.001"


def game(pk, state="Final", home=3, away=1, season="2001"):
    team = lambda i, s: {"team": {"id": i, "name": f"T{i}"}, "score": s}
    return {"gamePk": pk, "season": season, "officialDate": f"{season}-05-01", "gameType": "R", "status": {"abstractGameState": state}, "teams": {"home": team(1, home), "away": team(2, away)}}


def payload(*games):
    return {"dates": [{"date": "2001-05-01", "games": list(games)}]}


def test_schedule_files_whole_and_by_line(spark, tmp_path):
    (tmp_path / "whole").mkdir(), (tmp_path / "lines").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps(payload(game(1), game(2, "Preview")), indent=1))
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(payload(g)) for g in (game(1), game(2, "Preview"))))
    (tmp_path / "lines" / "b.json").write_text(json.dumps({"dates": []}))
    rows = [sorted(payloads.read_schedule(spark, str(tmp_path / d), lines).collect(), key=lambda r: r.game_pk) for d, lines in (("whole", False), ("lines", True))]
    assert rows[0] == rows[1] and [(r.game_pk, r.home_win) for r in rows[0]] == [(1, 1), (2, None)]


def test_csv_booleans_and_nulls(spark, tmp_path):
    (tmp_path / "g.csv").write_text("game_pk,score,flag\n1,,True\n2,4,false\n3,5,\n4,6,yes\n")
    got = payloads.read_games_csv(spark, str(tmp_path), "game_pk long, score int, flag boolean").orderBy("game_pk").collect()
    assert [tuple(r) for r in got] == [(1, None, True), (2, 4, False), (3, 5, None), (4, 6, None)]


def test_finals_arrive_once_and_in_their_season(spark, tmp_path):
    landing, target = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for name, games in (("a", [game(1), game(2, "Preview")]), ("b", [game(1), game(2), game(3, season="2002")]), ("c", []), ("d", [game(3, season="2002"), game(4, home=1)])):
        (landing / f"{name}.json").write_text(json.dumps(payload(*games)))
        stream = refresh.schedule_stream(spark, str(landing), files=1)
        refresh.append_finals(stream, str(target), str(tmp_path / "log")).start().awaitTermination()
    got = spark.read.parquet(str(target)).select("game_pk", "season").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2001), (2, 2001), (3, 2002)]  # the fourth is a tie


def test_latest_names(spark):
    rows = [(1, "a", 10, 20, "Old", "Other"), (2, "b", 20, 10, "Other", "New"), (3, "c", 10, 30, None, None)]
    games = spark.createDataFrame(rows, "game_pk int, date string, home_team_id int, away_team_id int, home_team_name string, away_team_name string")
    got = {r.team_id: r.team_name for r in ratings.latest_names(games, ("date", "game_pk")).collect()}
    assert got == {10: "New", 20: "Other"}
    assert ratings.latest_names(games.limit(0), ("date",)).count() == 0


def test_ordered_pairs(spark):
    teams = spark.createDataFrame([(i, float(i)) for i in range(9)], "team_id int, rating double")
    got = [(r.a.team_id, r.b.team_id) for r in ratings.ordered_pairs(teams).collect()]
    assert sorted(got) == sorted(permutations(range(9), 2))
    assert ratings.ordered_pairs(teams.limit(0)).count() == ratings.ordered_pairs(teams.limit(1)).count() == 0


def test_baseline_bands(spark):
    long = spark.createDataFrame([(m, y, p) for y, q in ((1, 0.7), (1, 0.6), (0, 0.2), (0, 0.6)) for m, p in (("constant", 0.54), ("elo", q))], "model string, y int, p double")
    got = {r.metric: (r.value, r.ok) for r in metrics.baseline_bands(long).collect()}
    assert got["constant_accuracy"] == (0.5, False) and got["elo_accuracy"] == (0.75, False) and got["elo_log_loss"][1]
    assert [(r.value, r.ok) for r in metrics.baseline_bands(long.limit(0)).collect()] == [(None, False)] * 3


def test_pair_occurrences(spark):
    brackets = spark.createDataFrame([("first", 1, 2), ("first", 2, 1), ("first", 1, 3), ("final", 1, 2)], "round string, hi int, lo int")
    pairs = spark.createDataFrame([("first", 1, 2), ("first", 2, 1), ("first", 2, 3), ("final", 2, 1), (None, 1, 2)], "round string, a_id int, b_id int")
    got = {(r["round"], r.a_id, r.b_id): r.n for r in standings.pair_occurrences(brackets, pairs).collect()}
    assert got == {("first", 1, 2): 2, ("first", 2, 1): 2, ("first", 2, 3): 0, ("final", 2, 1): 1, (None, 1, 2): None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pair_occurrences_of_all_simulations(spark):
    b, seeds, want = Base(spark, SF), {}, {}
    for r in scoring.sim_field(b).filter("seed between 3 and 6").collect():
        seeds.setdefault((r.sim, r.league), {})[r.seed] = r.team_id
    for s in seeds.values():
        for pair in ((s[3], s[6]), (s[4], s[5])):
            want[tuple(sorted(pair))] = want.get(tuple(sorted(pair)), 0) + 1
    assert sum(want.values()) == 4 * scoring.SIMS
    got = registry.queries()["j12_pair_occurrences"](spark, SF).collect()
    assert {(r.a_id, r.b_id): r.n for r in got if r.n} == want
    assert len(got) == 2 * 30 * 29 // 2 and sum(r["round"] is None and r.n is None for r in got) == 435


def test_matchups(spark):
    teams = spark.createDataFrame([(1, 1600.0), (2, 1400.0)], "team_id int, rating double")
    games = spark.createDataFrame([("a", 1, 2, False), ("b", 1, 2, True), ("c", 2, 1, True), ("d", 1, 9, None)], "game_pk string, home_id int, away_id int, neutral boolean")
    got = {r.game_pk: r.p for r in models.matchups_with(games, teams, outlook.by_rating).collect()}
    assert got["a"] > got["b"] > 0.5 and got["b"] + got["c"] == pytest.approx(1)
    elo = {r.game_pk: r.p for r in ratings.matchup_prob(games, teams).collect()}
    assert {k: got[k] for k in "ad"} == pytest.approx({k: elo[k] for k in "ad"}) and elo["b"] == pytest.approx(1 / (1 + 10 ** -0.5))
    assert models.matchups_with(games.limit(0), teams, outlook.by_rating).count() == 0
    for bad in (lambda x: pd.Series([0.5]), lambda x: x["home_rating"] * 0 + 1.0):
        with pytest.raises(Exception, match="probabilities"):
            models.matchups_with(games.repartition(1), teams.filter("team_id < 9"), bad).collect()
