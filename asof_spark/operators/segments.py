"""Values over the earlier rows of a key, without a task that holds a key's whole history.

Keys with more than HOT_ROWS rows are cut into segments of at most so many positions (`ord`, dense over all events).
A segment gets what it needs of the earlier ones: totals, last state or last rows, found by a pass over one small
row a segment. Where no key is that large nothing is cut and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most rows of a key that stay together.
HOT_ROWS = 1_000_000
#: Rows of a task that sorts them.
TASK_ROWS = 250_000


def deal(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows by keys on as many tasks as `total` rows need, so that a task's memory does not grow with the table.

    Left to itself Spark puts rows together by the size of compressed shuffles, or on as many tasks as there are cores.
    """
    tasks = max(-(-total // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys) if total > TASK_ROWS else rows


def by_key(table: DataFrame) -> DataFrame:
    """A table of games or logs as a side of a join by shuffle.

    Spark guesses sizes by compressed files and shuffles, where keys in order are next to nothing; a table that passes for small is then
    broadcast, which holds all of its rows in the driver.
    """
    return table.hint("merge")


def split_dealt(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """rows dealt by key, or cut as by split_hot and dealt by segment, and whether they are cut."""
    total, largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum("__n"), F.max("__n")).first()
    parts = split_hot(rows, keys) if (largest or 0) > HOT_ROWS else None
    out = rows if parts is None else parts
    return deal(out, total or 0, *in_segment(out, *keys)), parts is not None


def split_hot(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame | None:
    """rows with __seg, the segment of its key; None if no key has more than `most` rows. A key has few rows at one ord."""
    most = most or HOT_ROWS
    # at most one key in `most` rows is hot
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*keys, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return None
    seg = F.when(F.col("__hot"), F.floor(F.col("ord") / most)).otherwise(0).cast("long")
    return rows.join(F.broadcast(hot), keys, "left").withColumn("__seg", seg).drop("__hot")


def in_segment(rows: DataFrame, *keys: str) -> list[str]:
    """Partition columns of a window by these keys."""
    return [*keys, "__seg"] if "__seg" in rows.columns else list(keys)


def carried(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows of split_hot with the totals of their key's earlier segments, 0 for none."""
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "__seg").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = parts.select(*keys, "__seg", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])
    return rows.join(before, [*keys, "__seg"])


def with_context(rows: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """rows of split_hot and, ahead of each segment, the key's last `size` rows of earlier ones, marked __context.

    Context rows have keys, ord and `columns`; the other columns are null.
    """
    back = F.row_number().over(Window.partitionBy(*keys, "__seg").orderBy(F.desc("ord")))
    tails = rows.withColumn("__k", back).filter(F.col("__k") <= size).groupBy(*keys, "__seg").agg(F.collect_list(F.struct("ord", *columns)).alias("__tail"))
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(-size, -1)  # a segment has a row at least
    ahead = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("__tail").over(w)))), 1, size)
    context = tails.select(*keys, "__seg", ahead.alias("__ahead")).select(*keys, "__seg", F.explode("__ahead").alias("__row"))
    context = context.select(*keys, "__seg", "__row.*", F.lit(True).alias("__context"))
    return rows.withColumn("__context", F.lit(False)).unionByName(context, allowMissingColumns=True)


def last_before(states: DataFrame, probes: DataFrame, keys: list[str], columns: list[str], name: str, most: int | None = None) -> DataFrame:
    """probes with `name`, the columns of the last state of their key before their ord as a struct; null without one.

    States and probes are one ordered stream per key, so the work grows with their sum. At the same ord a probe comes first.
    """
    state = states.select(*keys, "ord", F.lit(1).alias("__kind"), F.struct(*columns).alias("__state"))
    probe = probes.select(*keys, "ord", F.lit(0).alias("__kind"), F.struct(*probes.columns).alias("__probe"))
    merged = state.unionByName(probe, allowMissingColumns=True)
    parts = split_hot(merged, keys, most)
    rows = merged if parts is None else parts
    w = Window.partitionBy(*in_segment(rows, *keys)).orderBy("ord", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__last", F.last("__state", ignorenulls=True).over(w))
    if parts is not None:
        ends = parts.groupBy(*keys, "__seg").agg(F.max_by("__state", F.when(F.col("__kind") == 1, F.col("ord"))).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1))
        found = found.join(ends.select(*keys, "__seg", before.alias("__before")), [*keys, "__seg"]).withColumn("__last", F.coalesce("__last", "__before"))
    return found.filter("__kind = 0").select("__probe.*", F.col("__last").alias(name))
