"""Column functions: innings notation, decisions, expected results, series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_to_outs(ip: Column) -> Column:
    """Innings in thirds ("6.1" = 19 outs); null and empty are null, any other fraction is an error."""
    text = F.trim(ip.cast("string"))
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    outs = F.when(text.rlike(r"^\d+(\.[012]?)?$"), whole.cast("int") * 3 + F.when(part == "", 0).otherwise(part.cast("int")))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("int")).otherwise(F.coalesce(outs, F.raise_error(F.concat(F.lit("not innings: "), text)).cast("int")))


def decision(pitcher_id: Column, winner_id: Column, loser_id: Column, note: Column) -> Column:
    """W or L by the game's ids, else the first token of a note like "(H, 12)" if it is S, H or BS."""
    token = F.regexp_extract(note, r"^\(\s*([A-Z]+)", 1)
    return F.when(pitcher_id == winner_id, "W").when(pitcher_id == loser_id, "L").when(token.isin("S", "H", "BS"), token)


def is_opener(is_starter: Column, outs: Column, batters: Column) -> Column:
    return is_starter & (outs <= 6) & (batters <= 9)


def fip_rate(home_runs: Column, walks: Column, hit_by_pitch: Column, strikeouts: Column, outs: Column) -> Column:
    """Fielding-independent runs per nine innings without the league constant; null without outs."""
    return F.try_divide((13 * home_runs + 3 * (walks + hit_by_pitch) - 2 * strikeouts).cast("double"), outs / F.lit(3.0))


def k_rate(strikeouts: Column, batters: Column) -> Column:
    return F.try_divide(strikeouts.cast("double"), batters.cast("double"))


def expected_home(home: Column, away: Column, advantage: float = 25.0) -> Column:
    """Chance of the home side from two ratings."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(home + F.lit(float(advantage)) - away) / 400.0))


def series_lengths(chances: str, games: int) -> Column:
    """Array of the chances to win a first-to-more-than-half series in exactly g games, g = 1..games.

    chances: SQL of an array of the chances game by game. State of the fold: chance of each score (wins x losses) still open.
    """
    need = games // 2 + 1
    start = f"cast(transform(sequence(0, {need * need - 1}), i -> if(i = 0, 1.0, 0.0)) as array<double>)"
    at = lambda w, lo: f"if({w} >= 0 and {lo} >= 0 and {w} < {need} and {lo} < {need}, s.open[greatest(0, {w}) * {need} + greatest(0, {lo})], 0D)"
    w, lo = f"(i div {need})", f"(i % {need})"
    nxt = f"transform(sequence(0, {need * need - 1}), i -> {at(f'cast({w} as int) - 1', f'cast({lo} as int)')} * p + {at(f'cast({w} as int)', f'cast({lo} as int) - 1')} * (1 - p))"
    won = f"aggregate(sequence(0, {need - 1}), 0D, (a, l) -> a + s.open[{need - 1} * {need} + l]) * p"
    return F.expr(f"aggregate({chances}, named_struct('open', {start}, 'won', cast(array() as array<double>)), (s, p) -> named_struct('open', {nxt}, 'won', array_append(s.won, {won})), s -> s.won)")
