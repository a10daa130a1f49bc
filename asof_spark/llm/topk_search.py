"""Exact top-k inner-product search through a pivot-distance index.

One more coordinate gives all vectors the same norm, so the largest inner product is the smallest distance. Every
vector is keyed by its nearest pivot and the distance to it; sorted annuli around the pivots are cut at quantiles.
A query first visits its nearest annuli; then the triangle inequality tells which other annuli can still hold a
better vector, and only those are visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Least and most pivots, vectors that an annulus should hold, and the most annuli of a pivot.
PIVOTS, MOST_PIVOTS, ANNULUS, MOST_ANNULI = 32, 512, 256, 64
#: Rows from which pivots are chosen, taken by a hash of the id. Every row is indexed.
SAMPLE_ROWS = 4096
#: Vectors in a block of an annulus, queries in a block, vectors that the first round visits at least.
BLOCK, QUERY_BLOCK, FIRST_VECTORS = 2048, 256, 2048
#: Least squared norm (after scaling) that is refused: below it every score, and every sum on the way to one, fits in a long.
LARGEST_SQUARE = 2.0**62
#: Queries whose best vectors a task holds before it hands them on.
HELD_QUERIES = 20_000


def index_size(vectors: int) -> tuple[int, int]:
    """Pivots and annuli of each for so many vectors: both grow with the root of their number, up to a fixed most."""
    pivots = min(MOST_PIVOTS, max(PIVOTS, int(vectors**0.5 / 8)))
    return pivots, min(MOST_ANNULI, max(2, vectors // (pivots * ANNULUS)))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v and square: floor(scale * x) of every component as little-endian 64-bit integers, and their sum of squares; vectors with null or non-finite components are left out."""
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [np.floor(scale * np.asarray(e, dtype=np.float64)) for e in b["x"]]
            for i, e in zip(b["id"], whole, strict=True):
                if e @ e >= LARGEST_SQUARE:
                    raise ValueError(f"vector {i}: components are too large for exact scores")
            fixed = [e.astype("<i8") for e in whole]
            yield pd.DataFrame({"id": b["id"], "v": [e.tobytes() for e in fixed], "square": [int(e @ e) for e in fixed]})

    return vectors.filter(fine & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("x")).mapInPandas(pack, "id long, v binary, square long")


def _matrix(rows, dim: int) -> np.ndarray:
    """Vectors of any length, filled up with zeros."""
    if all(len(r) == 8 * dim for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i8").reshape(len(rows), dim)
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, dtype="<i8")
    return out


def _lifted(m: np.ndarray, norm2: float) -> np.ndarray:
    m = m.astype(np.float64)
    return np.hstack([m, np.sqrt(np.maximum(0.0, norm2 - (m * m).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice, then three rounds of means; the order of the sample alone decides."""
    if len(sample) == 0:
        return sample
    picked, near = [0], _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[picked[-1:]])[:, 0])
    pivots = sample[picked]
    for _ in range(3):
        own = _distances(sample, pivots).argmin(1)
        pivots = np.array([sample[own == i].mean(0) if (own == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where all sums are exact there."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64) if most < 2**52 else queries @ vectors.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _scorer(dim: int, k: int):
    """Pairs of a block of vectors and a block of queries -> the k best of every query in this task, at or above its bound."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pd.DataFrame:
            rows = [(q, s, i) for q, (ss, ii) in held.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=["q", "score", "id"])

        for b in batches:
            for vs, lists, qs, bounds in zip(b["vs"], b["lists"], b["qs"], b["bounds"], strict=True):
                m, counts = _matrix(list(vs), dim), np.array([len(x) for x in lists])
                owner, ids = np.repeat(np.arange(len(counts)), counts), np.concatenate([np.asarray(x) for x in lists])
                found = _scores(_matrix(list(qs), dim), m)
                for q, bound, row in zip(qs, bounds, found, strict=True):
                    fine = np.flatnonzero(row >= bound)
                    if not len(fine):
                        continue
                    keep = np.flatnonzero(row[owner] >= bound)
                    s, i = row[owner][keep], ids[keep]
                    if q in held:
                        s, i = np.concatenate([held[q][0], s]), np.concatenate([held[q][1], i])
                    at = _best(s, i, k)
                    held[q] = (s[at], i[at])
                if len(held) > HELD_QUERIES:
                    yield out()
        if held:
            yield out()

    return score


def search(vectors: DataFrame, query_filter: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """The k rows with the largest integer inner product for every row that meets query_filter (SQL over `id`).

    Returns query_id, rank, vec_id, score; ties go to the smaller id, a row is no candidate of itself, and a
    query with fewer candidates gets them all. Components become floor(scale * x). Rows with a null id, a null
    vector or null or non-finite components take no part; shorter vectors count as filled up with zeros. Rows that
    repeat an id and vector are one query, but candidates of their own, of each other too. An empty table gives no
    rows; other columns are not read. A scaled vector with a squared norm from 2^62 on is an error. Equal vectors are one entry of the index
    with their k + 1 smallest ids, which is all that a result can hold, so a vector in a third of all rows is no hot
    key. The sample of SAMPLE_ROWS for the pivots, the bounds of the annuli and their counts (MOST_PIVOTS x
    MOST_ANNULI rows at most) are all that the driver sees; queries travel in blocks to the blocks of vectors.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    all_rows = common.cut(quantised(vectors, id_col, vector_col, scale), "vectors")
    most = Window.partitionBy("v").orderBy("id")
    classes = all_rows.withColumn("n", F.row_number().over(most)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [np.frombuffer(v, dtype="<i8") for v in b["v"]]
            yield pd.DataFrame({"v": b["v"], "ids": b["ids"], "dim": [len(x) for x in values], "norm2": [float((x.astype(float) ** 2).sum()) for x in values]})

    classes = common.cut(classes.mapInPandas(measured, "v binary, ids array<long>, dim int, norm2 double"), "classes")
    dim, norm2, entries = classes.agg(F.max("dim"), F.max("norm2"), F.count(F.lit(1))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if dim is None:
        return spark.createDataFrame([], result)
    n_pivots, n_annuli = index_size(entries)
    sample = [r[0] for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()]
    pivots = choose_pivots(_lifted(_matrix(sample, dim), norm2), n_pivots)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(_lifted(_matrix(list(b["v"]), dim), norm2), pivots)
                yield pd.DataFrame({"v": b["v"], "ids": b["ids"], "pivot": d.argmin(1), "distance": d.min(1)})

    index = common.cut(classes.select("v", "ids").mapInPandas(keyed, "v binary, ids array<long>, pivot int, distance double"), "index")
    parts = [i / n_annuli for i in range(1, n_annuli)]
    # one row for each pivot, then one for each annulus
    cuts = common.cut(index.groupBy("pivot").agg(F.percentile_approx("distance", parts).alias("cuts")), "cuts")
    ring = F.size(F.filter("cuts", lambda y: y < F.col("distance")))
    index = index.join(F.broadcast(cuts), "pivot").select("v", "ids", "distance", (F.col("pivot") * n_annuli + ring).alias("annulus"))
    bounds = common.cut(index.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")), "annuli")
    rings = bounds.orderBy("annulus").collect()
    names, low, high, count = (np.array(x) for x in zip(*rings, strict=True))
    # a distance is the root of a difference, so its error is up to the root of the rounding error of a squared norm
    low_slack = 1e-6 * np.sqrt(norm2) + 1e-6
    sizes = F.broadcast(bounds.select("annulus", F.ceil(F.col("n") / BLOCK).alias("chunks")))
    chunked = index.join(sizes, "annulus").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    blocks = chunked.groupBy("annulus", "chunk").agg(F.collect_list(F.struct("v", "ids")).alias("e"))
    blocks = common.cut(blocks.select("annulus", "chunk", F.col("e.v").alias("vs"), F.col("e.ids").alias("lists")), "blocks")

    def bounds_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance to each annulus and the largest inner product that it allows."""
        lifted = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        d = _distances(lifted, pivots)[:, names // n_annuli]
        least = np.maximum(0.0, np.maximum(d - high, low - d) - low_slack)
        return least, np.floor(((lifted * lifted).sum(1)[:, None] + norm2 - least**2) / 2 * (1 + 1e-9) + 1)

    def first_annuli(least: np.ndarray) -> np.ndarray:
        order = np.argsort(least, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        chosen = np.zeros(least.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < FIRST_VECTORS, axis=1)
        return chosen

    def visits(first: bool):
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), QUERY_BLOCK):
                    qs = list(b["q"].iloc[at : at + QUERY_BLOCK])
                    least, top = bounds_of(_matrix(qs, dim))
                    chosen = first_annuli(least)
                    bound = np.full(len(qs), np.iinfo(np.int64).min) if first else b["bound"].iloc[at : at + QUERY_BLOCK].to_numpy()
                    if not first:
                        chosen = ~chosen & (top >= bound[:, None].astype(float))
                    rows = [(int(names[j]), c, [qs[i] for i in some], [int(x) for x in bound[some]]) for j in range(len(names)) if len(some := np.flatnonzero(chosen[:, j])) for c in range(-(-int(count[j]) // BLOCK))]
                    yield pd.DataFrame(rows, columns=["annulus", "chunk", "qs", "bounds"])

        return visit

    def visited(queries: DataFrame, first: bool) -> DataFrame:
        # both sides grow with the input, which the planner cannot see behind the function: never broadcast
        asked = queries.mapInPandas(visits(first), "annulus int, chunk int, qs array<binary>, bounds array<long>")
        pairs = asked.hint("merge").join(blocks.hint("merge"), ["annulus", "chunk"])
        found = pairs.select("vs", "lists", "qs", "bounds").mapInPandas(_scorer(dim, k + 1), "q binary, score long, id long")
        return common.cut(_ranked(found, k + 1).drop("rank"), "visited")

    asked = all_rows.filter(query_filter).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "square").distinct()
    queries = common.cut(asked.select("q").distinct(), "queries")
    near = visited(queries, True)
    bound = near.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("q", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(-(1 << 63))).alias("bound"))
    best = common.cut(_ranked(near.unionByName(visited(common.cut(bound, "bounds"), False)), k + 1).drop("rank"), "best")
    # equal vectors can ask often, each for the same list
    pairs = common.even_join(common.cut(asked, "asked"), best.groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("found")), "q")
    pairs = pairs.select("query_id", "q", "square", F.explode("found").alias("f")).select("query_id", "q", "square", "f.*")
    # one row with the query's id and its own score is the query itself, if it is among the best
    itself = F.col("id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("square"))
    pairs = pairs.withColumn("itself", itself).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "q", "itself").orderBy("id")))
    own = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id")
    return pairs.filter("not (itself and n = 1)").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
