"""Audits whose answer on sound tables is always the same find faults that are planted, and tables switch at once."""

import os

import pytest
from pyspark.sql import functions as F

from asof_spark.operators import asof, audits, standings
from asof_spark.plans import scoring
from asof_spark.plans.base import Base
from asof_spark.sources import sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def features(spark):
    return asof.sinks.cut(Base(spark, SF).features, "features")


def test_differing_finds_changed_missing_and_null_values(features):
    key = features.agg(F.max(F.when(F.col("home_form_15").isNotNull(), F.col("game_pk")))).first()[0]
    assert audits.differing(features, features, ("game_pk",), audits.FEATURES).isEmpty()
    for change in (F.col("home_form_15") + 1e-6, F.lit(None).cast("double")):
        other = features.withColumn("home_form_15", F.when(F.col("game_pk") == key, change).otherwise(F.col("home_form_15")))
        assert [r.game_pk for r in audits.differing(features, other, ("game_pk",), audits.FEATURES).collect()] == [key]
    assert [r.game_pk for r in audits.differing(features, features.filter(F.col("game_pk") != key), ("game_pk",), audits.FEATURES).collect()] == [key]


def test_mode_agreement_and_future_deletion_find_a_later_result(spark, features, monkeypatch):
    """A feature that looks one game ahead differs once the future is cut off."""
    b, cutoff = Base(spark, SF), F.lit("1998-06-30").cast("date")
    inner = asof.run_diff_pg.__wrapped__

    def ahead(long):
        w = asof.Window.partitionBy("team_id").orderBy("ord")
        return inner(long).withColumn("run_diff_pg", F.coalesce("run_diff_pg", F.lit(0.0)) + F.coalesce(F.lead("run_diff").over(w), F.lit(0)))

    monkeypatch.setattr(asof.run_diff_pg, "__wrapped__", ahead)
    whole = Base(spark, SF).features.filter(F.col("date") <= cutoff)
    part = asof.build_features(b.played.filter(F.col("date") <= cutoff), b.logs, b.venues)
    assert not audits.differing(whole, part, ("game_pk",), audits.FEATURES).isEmpty()
    assert not audits.differing(features, Base(spark, SF).features, ("game_pk",), audits.FEATURES).isEmpty()


def test_serving_skew_finds_logs_that_serving_lacks(spark):
    b = Base(spark, SF)
    sound = scoring.l18_serving_skew(b).first()
    assert sound.differing == 0 and sound.games > 100 and 0 < sound.low_confidence
    monkey = Base(spark, SF)
    stored = monkey.features
    first = monkey.played.withColumn("k", F.row_number().over(asof.Window.partitionBy("date").orderBy("game_number", "game_pk"))).filter("k = 1 and venue_id is not null")
    asked = first.select((F.lit(-1) - F.col("game_pk")).alias("game_pk"), "season", "date", "game_number", "home_team_id", "away_team_id", "venue_id", F.lit(None).cast("long").alias("home_probable_id"), F.lit(None).cast("long").alias("away_probable_id"))
    live = asof.live_features(monkey.played, monkey.logs, monkey.venues, asked, look_up=False)
    got = audits.serving_skew(stored.join(first.select("game_pk"), "game_pk", "left_semi"), live).first()
    assert got.games == sound.games and got.differing > 0


def test_park_leakage_finds_a_season_of_its_own(spark):
    games = Base(spark, SF).ordered
    leaking = asof.park_factors(games, seasons=games.select((F.col("season") + 1).alias("season"))).withColumn("season", F.col("season") - 1).filter("season = 1999")
    sound = asof.park_factors(games.filter("season <= 1998"), seasons=games).filter("season = 1999")
    assert not audits.differing(sound, leaking, ("season", "venue_id"), ("park_factor",)).isEmpty()


def test_outlook_checks_find_each_fault(spark):
    field = spark.createDataFrame([(s, "a", t) for s in (0, 1) for t in range(6 - s)], "sim int, league string, team_id int")
    totals = spark.createDataFrame([(0, 1, 5, 4), (0, 2, 4, 5), (1, 1, 5, 4), (1, 2, 5, 4)], "sim int, team_id int, wins long, losses long")
    games = spark.createDataFrame([(1, 9), (2, 10)], "team_id int, games long")
    assert {r.check: r.bad for r in standings.outlook_checks(field, totals, games).collect()} == {"berths": 1, "wins_equal_losses": 1, "scheduled_total": 2}


def test_a_table_is_switched_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2000 + i % 3, i) for i in range(9)], "game_pk long, season int, date int")
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path, rows.schema)
    sinks.write_table(rows, path)
    old = sinks.read_table(spark, path, rows.schema)
    # a writer that stops between two partitions leaves files, but no manifest
    rows.filter("season = 2000").withColumn("game_pk", F.lit(-1)).write.partitionBy("season").parquet(f"{path}/v-stopped")
    assert sorted(r.game_pk for r in sinks.read_table(spark, path, rows.schema).collect()) == list(range(9))
    broken = rows.withColumn("game_pk", F.when(F.col("game_pk") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.lit(-2)))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(broken, path)
    assert sorted(r.game_pk for r in sinks.read_table(spark, path, rows.schema).collect()) == list(range(9))
    sinks.write_table(rows.filter("season = 2001"), path)
    assert {r.season for r in sinks.read_table(spark, path, rows.schema).collect()} == {2001}
    assert old.count() == 9  # a reader under way keeps its version
    sinks.write_table(rows.limit(0), path)
    assert sinks.read_table(spark, path, rows.schema).count() == 0


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    rows, path = spark.createDataFrame([(1, 2000, 1)], "game_pk long, season int, date int"), str(tmp_path / "table")
    sinks.write_table(rows, path)
    monkeypatch.setattr(sinks, "_latest", lambda *a: 0)
    with pytest.raises(FileExistsError):
        sinks.write_table(rows.limit(0), path)
    monkeypatch.undo()
    assert sinks.read_table(spark, path, rows.schema).count() == 1
