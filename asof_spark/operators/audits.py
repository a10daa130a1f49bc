"""Data-quality and leakage audits; each returns the figures or the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import segments
from .asof import FORM_GAMES, FORM_LEAST, ORDER, team_long
from .metrics import percentiles

FEATURES = ("home_form_15", "away_form_15", "home_run_diff_pg", "away_run_diff_pg", "home_rest_days", "away_rest_days", "away_tz_delta", "home_sp_fip", "away_sp_fip", "home_sp_k_rate", "away_sp_k_rate", "park_factor")


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def per_column(df: DataFrame, make, columns: tuple[str, ...], *names: str) -> DataFrame:
    """One aggregate over all columns, then one row per column. make(column) gives the aggregates in the order of names."""
    one = df.agg(*[F.struct(F.lit(c).alias("name"), *[a.alias(n) for n, a in zip(names, make(c), strict=True)]).alias(c) for c in columns])
    return one.select(F.explode(F.array(*columns)).alias("x")).select("x.*")


def season_counts(games: DataFrame, low: int, high: int) -> DataFrame:
    rows = games.filter("game_type = 'R'").groupBy("season").agg(count_if(F.col("is_final")).alias("played"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("never_played", F.col("total") - F.col("played")).withColumn("ok", F.col("played").between(low, high))


def team_counts(games: DataFrame, expected: int, tolerance: int) -> DataFrame:
    n = games.filter("game_type = 'R' and is_final").select("season", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("games"))
    return n.withColumn("ok", F.abs(F.col("games") - expected) <= tolerance)


def home_win_rate(games: DataFrame) -> DataFrame:
    return games.filter("game_type = 'R' and home_win is not null").rollup("season").agg(F.avg("home_win").alias("rate"), F.count(F.lit(1)).alias("n"))


def winner_flag_mismatches(games: DataFrame, flag: str = "home_is_winner_flag") -> DataFrame:
    return games.filter(F.col("home_win").isNotNull() & F.col(flag).isNotNull() & (F.col("home_win") != F.col(flag).cast("int")))


def bad_doubleheaders(games: DataFrame) -> DataFrame:
    """Repeated (date, home, away) whose game numbers are not distinct."""
    return games.groupBy("date", "home_team_id", "away_team_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_number").alias("numbers")).filter("n > 1").withColumn("clean", F.col("n") == F.col("numbers"))


def null_audit(games: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return per_column(games.filter("is_final"), lambda c: (count_if(F.col(c).isNull()), F.count(F.lit(1))), columns, "nulls", "n")


def league_records(games: DataFrame) -> DataFrame:
    """season, team_id: derived wins, the largest running record and the record at the last game, and which convention fits.

    games: with running wins of each side (home_wins_after, away_wins_after)."""
    side = lambda s, won: F.struct(F.col(f"{s}_team_id").alias("team_id"), won.alias("won"), F.col(f"{s}_wins_after").alias("after"))
    rows = games.filter("home_win is not null").select("season", F.struct(*ORDER).alias("o"), F.explode(F.array(side("home", F.col("home_win")), side("away", 1 - F.col("home_win")))).alias("s")).select("season", "o", "s.*")
    out = rows.groupBy("season", "team_id").agg(F.sum("won").cast("long").alias("wins"), F.max("after").cast("long").alias("max_after"), F.max_by("won", "o").alias("last_won"))
    return out.withColumn("convention", F.when(F.col("max_after") == F.col("wins"), "inclusive").when(F.col("max_after") == F.col("wins") - F.col("last_won"), "exclusive").otherwise("neither"))


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, status: only_left, only_right or differs; equal rows are left out."""
    a = left.select(F.col(key).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(F.col(key).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    status = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right").when(~same, "differs")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), status.alias("status")).filter("status is not null")


def backfill_gate(before: DataFrame, after: DataFrame, logs: DataFrame, least_coverage: float = 0.98) -> DataFrame:
    """metric, value, ok of a backfill: null results, history kept, unique keys, log coverage."""
    dup = after.groupBy("game_pk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("dup"))
    lost = before.select("game_pk").join(after.select("game_pk"), "game_pk", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    nulls = after.filter("is_final and home_win is null and home_score <> away_score").agg(F.count(F.lit(1)).alias("nulls"))
    finals = after.filter("is_final").select("game_pk").join(logs.select("game_pk").distinct().withColumn("has", F.lit(1)), "game_pk", "left").agg(F.avg(F.coalesce("has", F.lit(0))).alias("coverage"))
    one = nulls.join(lost).join(dup).join(finals)  # tables of one row
    checks = [("null_results", F.col("nulls").cast("double"), F.col("nulls") == 0), ("lost_rows", F.col("lost").cast("double"), F.col("lost") == 0), ("duplicate_keys", F.col("dup").cast("double"), F.col("dup") == 0), ("coverage", F.col("coverage"), F.col("coverage") >= least_coverage)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), ok.alias("ok")) for n, v, ok in checks])).alias("c")).select("c.*")


def log_coverage(games: DataFrame, rows: DataFrame) -> DataFrame:
    """season: games, games with logs on both sides, mean and most frequent number of pitchers of a side."""
    sides = rows.groupBy("game_pk", "is_home").agg(F.count_distinct("pitcher_id").alias("pitchers"))
    n = sides.groupBy("game_pk").agg(F.count(F.lit(1)).alias("sides"))
    both = games.select("game_pk", "season").join(n, "game_pk", "left").groupBy("season").agg(F.count(F.lit(1)).alias("games"), count_if(F.col("sides") == 2).alias("both_sides"))
    per = sides.join(games.select("game_pk", "season"), "game_pk").groupBy("season").agg(F.avg("pitchers").alias("mean_pitchers"), F.mode("pitchers", True).alias("mode_pitchers"))
    return both.join(per, "season", "left")


def outs_distribution(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("game_pk", "is_home").agg(F.sum("ip_outs").alias("outs"))
    return per.groupBy("outs").agg(F.count(F.lit(1)).alias("n")).withColumn("remainder", F.col("outs") % 3)


def runs_against(games: DataFrame, rows: DataFrame, value: str = "home_runs") -> DataFrame:
    """game_pk, side, allowed, scored: summed log value of a side against the opponent's score, where they differ."""
    per = rows.groupBy("game_pk", "is_home").agg(F.sum(value).alias("allowed"))
    joined = per.join(games.select("game_pk", "home_score", "away_score"), "game_pk")
    return joined.select("game_pk", "is_home", "allowed", F.when(F.col("is_home"), F.col("away_score")).otherwise(F.col("home_score")).cast("long").alias("scored")).filter("allowed <> scored")


def faced_differences(rows: DataFrame) -> DataFrame:
    """Histogram of batters faced by a side less its opponent's plate appearances (here: the other side's faced plus outs)."""
    per = rows.groupBy("game_pk", "is_home").agg(F.sum("batters_faced").alias("faced"), F.sum("ip_outs").alias("outs"))
    a, b = per.filter("is_home"), per.filter("not is_home").select("game_pk", F.col("outs").alias("other_outs"))
    return a.join(b, "game_pk").groupBy((F.col("faced") - F.col("other_outs")).alias("difference")).agg(F.count(F.lit(1)).alias("n"))


def starter_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("game_pk", "is_home").agg(count_if(F.col("is_starter")).alias("starters")).groupBy("starters").agg(F.count(F.lit(1)).alias("n"))


def leaderboard(rows: DataFrame, least_outs: int = 486, k: int = 5) -> DataFrame:
    """The k best runs-per-nine of each season among pitchers with least_outs, and the strikeout leader's mark."""
    per = rows.groupBy("season", "pitcher_id").agg(F.sum("ip_outs").alias("outs"), F.sum("home_runs").alias("runs"), F.sum("strikeouts").alias("strikeouts"))
    per = per.withColumn("era", F.try_divide(F.col("runs") * 27.0, F.col("outs"))).withColumn("k_rank", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("strikeouts"), "pitcher_id")))
    best = F.row_number().over(Window.partitionBy("season").orderBy("era", "pitcher_id"))
    return per.filter(F.col("outs") >= least_outs).withColumn("rank", best).filter(F.col("rank") <= k).select("season", "rank", "pitcher_id", "era", "strikeouts", "k_rank")


def duplicate_logs(rows: DataFrame) -> DataFrame:
    """game_pk, pitcher_id, n, sides of players that occur more than once in a game."""
    return rows.groupBy("game_pk", "pitcher_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("is_home").alias("sides")).filter("n > 1 or sides > 1")


def unflagged_nulls(features: DataFrame) -> DataFrame:
    """Per season: null features without their low-confidence flag, and the flags' shares."""
    bad = lambda c, f: count_if(F.col(c).isNull() & ~F.col(f))
    share = lambda c: F.avg(F.col(c).cast("int"))
    return features.groupBy("season").agg(bad("home_form_15", "home_form_low_confidence").alias("home_form_unflagged"), bad("away_form_15", "away_form_low_confidence").alias("away_form_unflagged"), share("home_form_low_confidence").alias("home_form_low"), share("home_sp_low_confidence").alias("home_sp_low"))


def season_reset(long: DataFrame) -> DataFrame:
    """First game of each team and season: rows, games played of 0, null form."""
    first = long.withColumn("k", F.row_number().over(Window.partitionBy("team_id", "season").orderBy("ord"))).filter("k = 1")
    return first.groupBy("season").agg(F.count(F.lit(1)).alias("teams"), count_if(F.col("games_played") == 0).alias("zero_played"), count_if(F.col("form_15").isNull()).alias("null_form"))


def feature_distribution(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """name, min, p1, median, p99, max; a column without values has nulls. features are read several times and should be stored."""
    ends = per_column(features, lambda c: (F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))), columns, "min", "max")
    long = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    q = F.col("q")
    return ends.join(percentiles(long, [0.01, 0.5, 0.99]), "name", "left").select("name", "min", q[0].alias("p1"), q[1].alias("median"), q[2].alias("p99"), "max")


def label_correlations(features: DataFrame, columns: tuple[str, ...] = FEATURES, alarm: float = 0.20) -> DataFrame:
    labelled = features.filter("home_win is not null")
    rows = per_column(labelled, lambda c: (F.corr(F.col(c).cast("double"), F.col("home_win").cast("double")),), columns, "corr")
    return rows.withColumn("alarm", F.coalesce(F.abs("corr") > alarm, F.lit(False)))


def large_tz_changes(long: DataFrame, venues: DataFrame, least: int = 3) -> DataFrame:
    """Changes of at least `least` hours where neither venue is abroad (offset >= 0)."""
    rows = long.join(venues.select("venue_id", "offset"), "venue_id", "left")
    before = F.lag("offset").over(Window.partitionBy("team_id", "season").orderBy("ord"))
    return rows.withColumn("before", before).filter((F.abs(F.col("offset") - F.col("before")) >= least) & (F.col("offset") < 0) & (F.col("before") < 0)).select("game_pk", "team_id", "before", "offset")


def shuffled_labels(rows: DataFrame, seed: int = 1, label: str = "home_win") -> DataFrame:
    """game_pk, label of some other row: a permutation by two numberings, by key and by seeded hash.

    Rows are numbered in two levels (buckets of the hash, then inside), so no window holds all rows.
    """
    def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
        b = df.withColumn("__b", F.floor((order.cast("double") / float(1 << 63) + 1.0) * 128).cast("int")).withColumn("__o", order)
        sizes = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
        before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
        return b.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__o", "game_pk"))).join(before, "__b").select(name, (F.col("__before") + F.col("__i")).alias("n"))

    keys = numbered(rows, F.xxhash64("game_pk"), "game_pk")
    labels = numbered(rows, F.xxhash64(F.lit(seed), "game_pk"), label)
    return keys.join(labels, "n").select("game_pk", label)


def recompute_form(games_ordered: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """form_15 and run_diff_pg of every game (with keys: of their game_pk) by their definition, with joins instead of windows over rows.

    Form: each game is sent to the next FORM_GAMES places of its team's season. Run difference: totals of the team's days,
    joined to the later days of the season (a calendar bounds them), and to later games of the same day.
    """
    key = ["team_id", "season"]
    long = team_long(games_ordered).select("game_pk", *key, "date", "ord", "won", "run_diff")
    placed = long.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("ord")))
    ahead = F.explode(F.sequence(F.col("place") + 1, F.col("place") + FORM_GAMES))
    near = placed.select(*key, "won", ahead.alias("place")).groupBy(*key, "place").agg(F.sum("won").alias("w"), F.count("won").alias("d"))
    days = long.groupBy(*key, "date").agg(F.sum("run_diff").alias("r"), F.count(F.lit(1)).alias("n"))
    earlier = days.select(*key, F.col("date").alias("day"), "r", "n")
    past = days.select(*key, "date").join(earlier, key).filter("day < date").groupBy(*key, "date").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    same = long.select(*key, "date", F.col("ord").alias("o"), F.col("run_diff").alias("x"))
    today = long.select("game_pk", *key, "date", "ord").join(same, [*key, "date"]).filter("o < ord").groupBy("game_pk", "team_id").agg(F.sum("x").alias("r2"), F.count(F.lit(1)).alias("n2"))
    asked = placed if keys is None else placed.join(keys.select("game_pk"), "game_pk", "left_semi")
    rows = asked.join(near, [*key, "place"], "left").join(past, [*key, "date"], "left").join(today, ["game_pk", "team_id"], "left")
    n, r = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for a, b in (("n", "n2"), ("r", "r2")))
    return rows.select("game_pk", "team_id", F.when(F.col("d") >= FORM_LEAST, F.col("w") / F.col("d")).alias("form_15"), F.when(n >= FORM_LEAST, r / n).alias("run_diff_pg"))


def differing(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """Rows of a whose columns differ from those of b by more than tolerance, or that b lacks."""
    right = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    off = F.col("__there").isNull()
    for c in columns:
        x, y = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return a.join(segments.by_key(right), list(keys), "left").filter(off).select(*keys)


def serving_skew(stored: DataFrame, live: DataFrame) -> DataFrame:
    """games, low_confidence (a starter of few outs on either side) and differing: stored rows whose features the serving path gives otherwise.

    live: rows of live_features for targets whose key is -1 less the game's.
    """
    served = live.withColumn("game_pk", F.lit(-1) - F.col("game_pk"))
    bad = differing(stored, served, ("game_pk",), FEATURES).agg(F.count(F.lit(1)).alias("differing"))
    return stored.agg(F.count(F.lit(1)).alias("games"), count_if(F.col("home_sp_low_confidence") | F.col("away_sp_low_confidence")).alias("low_confidence")).join(bad)  # two rows of one


def order_violations(provenance: DataFrame) -> DataFrame:
    return provenance.filter("last_ord >= ord")


def stratified_sample(games: DataFrame, per_bucket: int, seed: int = 1) -> DataFrame:
    """per_bucket games of the early, middle and late months each, by a seeded hash."""
    bucket = F.when(F.month("date") <= 4, "early").when(F.month("date") <= 8, "middle").otherwise("late")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), "game_pk"), "game_pk"))
    return games.withColumn("bucket", bucket).withColumn("__k", rank).filter(F.col("__k") <= per_bucket).drop("__k")
