"""Windows of hot teams and pitchers: cut into segments they give what the uncut ones give."""

import os

import pytest
from pyspark.sql import functions as F

from asof_spark.operators import asof, segments
from asof_spark.plans import batch
from asof_spark.plans.base import Base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def hot(spark):
    """Games in half of which team 3 plays, and logs of which pitcher 1 has nearly half; written once."""
    b = Base(spark, SF)
    other = (F.col("away_team_id") != 3) & (F.col("game_pk") % 2 == 0)
    games = b.played.withColumn("home_team_id", F.when(other, 3).otherwise(F.col("home_team_id"))).filter("home_team_id <> away_team_id")
    games = asof.sinks.cut(games, "hot-games")
    logs = b.logs.withColumn("pitcher_id", F.when(F.col("is_starter") & F.col("is_home"), 1).otherwise(F.col("pitcher_id")))
    logs = asof.sinks.cut(logs.dropDuplicates(["game_pk", "pitcher_id"]), "hot-logs")
    ordered = asof.sinks.cut(asof.canonical_order(games), "hot-ordered")
    share = asof.team_long(ordered).filter("team_id = 3").count() / games.count()
    assert share > 0.45
    return b, games, logs, ordered


def values(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def both(monkeypatch, make):
    """Results uncut and with segments of 13 positions, and how often something was cut."""
    whole = values(make())
    cuts, split = [], segments.split_hot

    def counted(*args, **kw):
        out = split(*args, **kw)
        cuts.append(out is not None)
        return out

    monkeypatch.setattr(segments, "HOT_ROWS", 13)
    monkeypatch.setattr(asof, "BUCKET_OUTS", 90)
    monkeypatch.setattr(segments, "split_hot", counted)
    assert values(make()) == whole and whole
    assert any(cuts)


TEAM = {
    "form": asof.form, "form across seasons": lambda x: asof.form(x, True), "games_played": asof.games_played,
    "run_diff_pg": asof.run_diff_pg, "rest_days": asof.rest_days,
}


@pytest.mark.parametrize("name", TEAM)
def test_team_windows(hot, monkeypatch, name):
    both(monkeypatch, lambda: TEAM[name](asof.team_long(hot[3])))


def test_all_team_features(hot, monkeypatch):
    both(monkeypatch, lambda: asof.team_features(hot[3], hot[0].venues))


@pytest.mark.parametrize("cross_season", [True, False])
def test_pitcher_windows(hot, monkeypatch, cross_season):
    rows = asof.log_rows(hot[2], hot[3]).select("pitcher_id", "game_pk", "season", "ord", *asof.COUNTS)
    # many appearances without an out, too
    rows = rows.withColumn("ip_outs", F.when(F.col("game_pk") % 3 == 0, 0).otherwise(F.col("ip_outs")).cast("long"))
    both(monkeypatch, lambda: asof.pitcher_window(rows, cross_season))


def test_live_features(hot, monkeypatch):
    b, games, logs, _ = hot
    both(monkeypatch, lambda: asof.live_features(games, logs, b.venues, batch.slate_of(b)).drop("ord"))


def test_last_before_takes_no_state_of_its_own_place(spark, monkeypatch):
    states = spark.createDataFrame([("a", i, i) for i in range(0, 40, 2)] + [("b", 3, 3), ("c", 0, None)], "k string, ord long, v long")
    probes = spark.createDataFrame([("a", i, f"a{i}") for i in (0, 1, 2, 17, 39, 500)] + [("b", 2, "b2"), ("b", 4, "b4"), ("c", 9, "c9"), ("d", 1, "d1")], "k string, ord long, name string")
    want = {"a0": None, "a1": 0, "a2": 0, "a17": 16, "a39": 38, "a500": 38, "b2": None, "b4": 3, "c9": None, "d1": None}
    for most in (1000, 5):
        got = segments.last_before(states, probes, ["k"], ["v"], "s", most)
        assert {r.name: r.s.v if r.s else None for r in got.collect()} == want
    assert segments.last_before(states.limit(0), probes, ["k"], ["v"], "s").filter("s is not null").count() == 0
    assert segments.last_before(states, probes.limit(0), ["k"], ["v"], "s").count() == 0


def test_no_segment_holds_a_whole_history(hot):
    parts = segments.split_hot(asof.team_long(hot[3]), ["team_id"], 13)
    assert parts.filter("team_id = 3").groupBy("__seg").count().agg(F.max("count")).first()[0] <= 13
    assert segments.split_hot(asof.team_long(hot[3]), ["team_id"], 10_000) is None


def test_components_pair_any_two_teams(hot):
    b = hot[0]
    parts = asof.team_components(b.played, b.logs, b.venues, b.teams, batch.DAY("2001-06-01"))
    assert parts.count() == 2 * b.teams.count()
    pairs = parts.sparkSession.createDataFrame([(1, 2), (2, 1), (1, 99)], "home_team_id int, away_team_id int")
    got = {(r.home_team_id, r.away_team_id): r for r in asof.pair_components(pairs, parts).collect()}
    assert got[1, 2].home_form_15 == got[2, 1].away_form_15 and got[1, 2].away_sp_fip == got[2, 1].home_sp_fip
    assert got[1, 99].away_form_15 is None and got[1, 2].away_tz_delta == 0
