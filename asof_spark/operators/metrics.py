"""Probability metrics and calibration tables. Inputs have y (0/1) and p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLIP = 1e-6
# Left edges of the ten bins, as floating point gives them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def clipped(p: Column, least: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))


def log_loss_of(y: Column, p: Column) -> Column:
    return -F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def evaluate(df: DataFrame, *by: str, at_half: bool = False, clip: float = CLIP) -> DataFrame:
    """n, accuracy (p > 0.5, or >= with at_half), log_loss and brier on clipped p, mean_pred, base_rate."""
    y, p = F.col("y"), F.col("p")
    c = clipped(p, clip)
    right = F.when((p >= 0.5) if at_half else (p > 0.5), y).otherwise(1 - y)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), log_loss_of(y, c).alias("log_loss"), F.avg((c - y) * (c - y)).alias("brier"), F.avg(p).alias("mean_pred"), F.avg(y).alias("base_rate"))


#: Ranges of values over which running counts are taken, WIDTH x WIDTH of about equally many distinct values.
WIDTH = 32


def with_range(cells: DataFrame, value: str, *by: str) -> DataFrame:
    """cells with __at, the range of its value: -1 for null, growing with the value, NaN last.

    Edges are quantiles of the values of each group of `by`, so distinct values that lie close together are still spread
    over the ranges. by: a short list of names, or nothing.
    """
    n = WIDTH * WIDTH
    at = F.percentile_approx(F.nanvl(value, F.lit(None)), [i / n for i in range(1, n)], 10 * n).alias("__edges")
    edges = cells.groupBy(*by).agg(at) if by else cells.agg(at)
    edges = F.broadcast(edges.select(*by, "__edges", F.transform(F.sequence(F.lit(1), F.lit(WIDTH - 1)), lambda i: F.get("__edges", i * WIDTH - 1)).alias("__coarse")))  # a row a name
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(value)))
    rows = (cells.join(edges, list(by), "left") if by else cells.join(edges)).withColumn("__c", below("__coarse"))
    place = F.col("__c") * (WIDTH + 1) + below(F.slice("__edges", F.col("__c") * WIDTH + 1, F.lit(WIDTH)))
    place = F.when(F.col(value).isNull(), -1).when(F.isnan(value), WIDTH * (WIDTH + 1) + 1).otherwise(F.coalesce(place, F.lit(0)))
    return rows.withColumn("__at", place.cast("int")).drop("__edges", "__coarse", "__c")


def auc(df: DataFrame, *by: str) -> DataFrame:
    """Area under the curve with ties averaged; null with one class or one value of p. by: names of few values.

    Counts run over the table of ranges of p first and then inside a range, over distinct p only.
    """
    cells = df.withColumn("p", F.col("p").cast("double")).groupBy(*by, "p").agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    cells = with_range(cells, "p")
    ranges = cells.groupBy(*by, "__at").agg(F.sum("neg").alias("__neg"))
    before = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # some WIDTH x WIDTH rows
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__neg").over(before), F.lit(0))).drop("__neg")
    inside = Window.partitionBy(*by, "__at").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    left, right = cells.withColumn("__in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("c"), ranges.alias("r")
    same = F.col("c.__at") == F.col("r.__at")
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}"))
    rows = left.join(right, same).select("c.*", (F.col("r.__before") + F.col("c.__in")).alias("below"))
    won = F.col("pos") * (F.col("below") + F.col("neg") / 2.0)
    total = rows.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("values"))
    return total.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("values") > 1), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def percentiles(long: DataFrame, at: list[float]) -> DataFrame:
    """name, q: exact interpolated percentiles of value for each name (a short list of names). long: name, value.

    Distinct values are counted first, and their counts run over ranges of about equally many of them, then inside the ranges that
    hold a wanted rank. Nulls are left out; a name without values has no row.
    """
    cells = long.filter("value is not null").groupBy("name", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = with_range(cells, "value", "name")
    ranges = placed.groupBy("name", "__at").agg(F.sum("n").alias("m"))
    running = Window.partitionBy("name").orderBy("__at")  # some WIDTH x WIDTH rows
    ranges = ranges.select("*", (F.sum("m").over(running) - F.col("m")).alias("first"), F.sum("m").over(Window.partitionBy("name")).alias("total"))
    spot = (F.col("total") - 1) * F.col("f")
    wanted = ranges.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(at)]))).select("*", "k.*")
    wanted = wanted.select("name", "__at", "first", "i", spot.alias("spot"), F.explode(F.array(F.floor(spot), F.ceil(spot))).alias("rank"), "m")
    wanted = wanted.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("m"))).drop("m").distinct()
    here = placed.join(F.broadcast(wanted.select("name", "__at", "first").distinct()), ["name", "__at"])  # two a percentile
    upto = here.withColumn("end", F.col("first") + F.sum("n").over(Window.partitionBy("name", "__at").orderBy("value")))
    hit = upto.select("name", "__at", "value", "n", "end").join(F.broadcast(wanted.drop("first")), ["name", "__at"]).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    ends = hit.groupBy("name", "i").agg(F.first("spot").alias("spot"), F.min("value").alias("a"), F.max("value").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("spot") - F.col("spot")) * F.col("a") + (F.col("spot") - F.floor("spot")) * F.col("b"))
    return ends.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("q"))


def compare(results: DataFrame) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.orderBy("log_loss", "model")))


def to_long(df: DataFrame, models: dict[str, str], y: str = "home_win", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row and model: model, y, p. models: name -> column."""
    return df.select(*keep, F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in models.items()])).alias("m")).select(*keep, "y", "m.*")


def by_subset(long: DataFrame, low_confidence: str = "low_confidence") -> DataFrame:
    """Metrics per model for the overlapping subsets all and high_conf."""
    subsets = F.when(F.col(low_confidence), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("high_conf")))
    return evaluate(long.withColumn("subset", F.explode(subsets)), "model", "subset")


def bin_of(p: Column) -> Column:
    """0..9: left-closed bins of fixed width, 1 in the last."""
    out = F.lit(0)
    for i, edge in enumerate(EDGES[1:], 1):
        out = F.when(p >= F.lit(edge), F.lit(i)).otherwise(out)
    return out


def reliability(df: DataFrame) -> DataFrame:
    """Ten rows, empty bins with null statistics."""
    bins = df.sparkSession.createDataFrame([(i, e, EDGES[i + 1] if i < 9 else 1.0) for i, e in enumerate(EDGES)], "bin int, bin_lo double, bin_hi double")
    found = df.groupBy(bin_of(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("mean_actual"))
    return bins.join(found, "bin", "left").select("bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "mean_actual", (F.col("mean_pred") - F.col("mean_actual")).alias("gap"))


def ece(table: DataFrame) -> DataFrame:
    used = table.filter("n > 0")
    return used.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def distribution(df: DataFrame, low: float = 0.35, high: float = 0.68) -> DataFrame:
    at = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    shape = df.agg(F.min("p").alias("min"), F.max("p").alias("max"), F.avg(F.when((F.col("p") < low) | (F.col("p") > high), 1.0).otherwise(0.0)).alias("outside"))
    q = shape.join(percentiles(df.select(F.lit("p").alias("name"), F.col("p").alias("value")), at), how="left")  # one row each
    return q.select("min", *[F.col("q")[i].alias(f"p{round(100 * a)}") for i, a in enumerate(at)], "max", "outside")


def by_decile(df: DataFrame, parts: int = 10) -> DataFrame:
    """Equal-count bins by exact quantile edges, right-closed: n, mean_pred, observed, gap."""
    edges = percentiles(df.select(F.lit("p").alias("name"), F.col("p").alias("value")), [i / parts for i in range(1, parts)]).select(F.col("q").alias("edges"))
    binned = df.join(F.broadcast(edges)).withColumn("decile", F.size(F.filter("edges", lambda e: e < F.col("p"))))  # one row of edges
    return binned.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("observed")).withColumn("gap", F.col("mean_pred") - F.col("observed"))


def most_extreme(df: DataFrame, key: str = "game_pk", k: int = 10) -> DataFrame:
    return df.withColumn("distance", F.abs(F.col("p") - 0.5)).orderBy(F.desc("distance"), key).limit(k)


def overconfidence(df: DataFrame, raw: str, least: float = 0.80) -> DataFrame:
    """Share of p beyond `least` either way, and the ranges of p and of the raw model."""
    share = lambda c: F.avg(F.when((F.col(c) > least) | (F.col(c) < 1 - least), 1.0).otherwise(0.0))
    return df.agg(share("p").alias("share"), share(raw).alias("raw_share"), F.max("p").alias("max_p"), F.max(raw).alias("raw_max_p"), (F.max("p") - F.min("p")).alias("range"), (F.max(raw) - F.min(raw)).alias("raw_range"))


def backtest_summary(df: DataFrame, model: str, baseline: str, y: str = "home_win") -> DataFrame:
    """Accuracy at p >= 0.5, log loss clipped at 1e-15 and the edge over the baseline."""
    long = to_long(df, {"model": model, "baseline": baseline}, y)
    rows = evaluate(long, "model", at_half=True, clip=1e-15)
    pick = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    return rows.agg(F.max("n").alias("n"), pick("accuracy", "model").alias("accuracy"), pick("log_loss", "model").alias("log_loss"), pick("log_loss", "baseline").alias("baseline_log_loss"), (pick("log_loss", "baseline") - pick("log_loss", "model")).alias("edge"))


def constant_baseline(train: DataFrame, rows: DataFrame, y: str = "home_win") -> DataFrame:
    return rows.join(F.broadcast(train.agg(F.avg(y).alias("p"))))  # one row


def tripwires(df: DataFrame, baseline_rows: int, train_rate: float) -> DataFrame:
    """metric, value, ok for the checks that a fitted model must pass."""
    m = evaluate(df).join(df.agg(F.min("p").alias("lo"), F.max("p").alias("hi")))  # two rows of one
    checks = [("accuracy", F.col("accuracy"), F.col("accuracy") < 0.62), ("least_p", F.col("lo"), F.col("lo") > 0), ("largest_p", F.col("hi"), F.col("hi") < 1), ("rows", F.col("n").cast("double"), F.col("n") == baseline_rows), ("mean_pred", F.col("mean_pred"), F.abs(F.col("mean_pred") - train_rate) < 0.05)]
    return m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), ok.alias("ok")) for n, v, ok in checks])).alias("c")).select("c.*")


# Bands that the accuracies of the two baselines must lie in.
BANDS = {"constant": (0.51, 0.57), "elo": (0.52, 0.60)}


def baseline_bands(long: DataFrame, constant: str = "constant", rated: str = "elo", bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """metric, value, low, high, ok: the accuracy of each baseline against its band (edges included), and the log loss of the
    rated one, which must be lower than the constant's. long: model, y, p. A model without rows gives a null value, not ok."""
    of = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    m = evaluate(long, "model").agg(*[of(c, x).alias(f"{x}_{c}") for x in (constant, rated) for c in ("accuracy", "log_loss")])
    checks = [(f"{x}_accuracy", F.col(f"{x}_accuracy"), F.lit(low), F.lit(high), F.col(f"{x}_accuracy").between(low, high)) for x, (low, high) in bands.items()]
    loss, limit = F.col(f"{rated}_log_loss"), F.col(f"{constant}_log_loss")
    checks.append((f"{rated}_log_loss", loss, F.lit(None).cast("double"), limit, loss < limit))
    row = lambda n, v, low, high, ok: F.struct(F.lit(n).alias("metric"), v.alias("value"), low.alias("low"), high.alias("high"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return m.select(F.explode(F.array(*[row(*c) for c in checks])).alias("c")).select("c.*")
