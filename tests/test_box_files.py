"""Boxscores are landed as text without being parsed first, and pitchers are looked up before rows are made."""

import os

import pytest

from asof_spark.plans import batch, files, registry
from asof_spark.plans.base import Base
from asof_spark.sources import payloads

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_landing_parses_nothing(spark, monkeypatch):
    want = sorted(map(tuple, registry.queries()["a2_pitchers"](spark, SF).collect()), key=repr)

    def parsed(*args):
        raise AssertionError("parsed before landing")

    monkeypatch.setattr(batch.F, "from_json", parsed)
    landed = files.landed_boxes(Base(spark, SF))
    columns = ("game_pk", "side", "pitcher_id", "appearance_order", "is_starter", "ip_outs", "batters_faced", "is_opener", "decision")
    assert sorted(map(tuple, payloads.parse_pitchers(landed).select(*columns).collect()), key=repr) == want and want


def test_pitchers_without_a_player_stay(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"game_pk": 1, "teams": {"home": {"team": {"id": 5}, "pitchers": [8, 7], "players": {"ID7": {"person": {"id": 7}, "stats": {"pitching": {"battersFaced": 3}}}}}, "away": {"team": {"id": 6}}}}')
    got = payloads.parse_pitchers(payloads.read_boxscores(spark, str(tmp_path))).collect()
    assert sorted((r.pitcher_id, r.appearance_order, r.is_starter, r.batters_faced) for r in got) == [(7, 2, False, 3), (8, 1, True, None)]
