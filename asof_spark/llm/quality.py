"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A Gaussian kernel over standardised statistics is approximated by cosines of random projections. Partitions sum
their normal equations, the sums are added by Spark, and the ridge weights are solved from one small matrix. Raw
scores become probabilities by isotonic regression on rows that the weights were not fitted on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STATISTICS = ("log_bytes", "log_words", "word_length", "long_words", "distinct", "repeated", "upper", "digits", "marks", "symbols", "pipes", "bangs", "stops", "line_words", "joined", "packed")
FEATURES, BANDWIDTH, RIDGE, SEED = 192, 3.0, 1.0, 11
#: Raw scores are counted in so many bins before the isotonic fit.
BINS = 4096
#: Hashes of rejected texts (about 40 bytes each) are broadcast up to so many; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of a text that one compression covers; every block of a text is compressed.
BLOCK = 1 << 16

_UPPER, _DIGIT, _MARK, _SYMBOL = np.zeros(256), np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91], _DIGIT[48:58] = 1, 1
_MARK[[ord(c) for c in ".,;:?'\"-()"]] = 1
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~/\\"]] = 1


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, in the order of STATISTICS; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    n, words = len(data), text.split()
    seen, w = np.bincount(np.frombuffer(data, np.uint8), minlength=256), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    packed = sum(len(zlib.compress(data[i : i + BLOCK], 1)) for i in range(0, n, BLOCK))
    return [
        math.log1p(n),
        math.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 15).mean()) if len(words) else 0.0,
        len(set(words)) / math.sqrt(w),
        sum(map(eq, words, words[1:])) / w,
        float(seen @ _UPPER) / n,
        float(seen @ _DIGIT) / n,
        float(seen @ _MARK) / w,
        float(seen @ _SYMBOL) / w,
        float(seen[124]) / w,
        float(seen[33]) / w,
        float(seen[46]) / w,
        math.log1p(len(words) / (1 + int(seen[10]))),
        float((lengths > 30).sum()) / w,
        packed / n,
    ]


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (a hash of the text) and x, the statistics of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "x": [statistics(t) for t in b["text"]]})

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return common.map_frames(texts, run, "doc_id long, key binary, x array<double>")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


class Model:
    """Standardisation, random projection, ridge weights and the isotonic steps: a few thousand numbers."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.projection = rng.normal(size=(len(mean), features)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.probability = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6) @ self.projection + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.map(x) @ self.weights, 0.0, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.probability), 0.0, 1.0)


def isotonic(at: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing fit by pooling adjacent violators: mean position and rate of each pool, each pool smoothed by half a row of either class."""
    pools: list[list[float]] = []
    for a, g, t in zip(at, good, total, strict=True):
        pools.append([a * t, g, t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    where = np.array([p[0] / p[2] for p in pools])
    rate = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return np.concatenate([[-1e-9], where, [1 + 1e-9]]), np.maximum.accumulate(np.concatenate([[min(0.0, rate[0])], rate, [max(1.0, rate[-1])]]))


def fit(measured: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """Fit on the labelled rows of fold 0 and calibrate on those of fold 2; fold 1 is never read for labels.

    measured: doc_id and x; labels: doc_id and quality. Rows with a null label or id are left out; several labels
    of an id each count. With no labelled row, or one class alone, every score is the base rate (0.5 if none).
    """
    stats = measured.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).orderBy("i").collect()
    if not stats:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model = Model(np.array([r[1] for r in stats]), np.array([r[2] for r in stats]))
    marked = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = common.cut(measured.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 1").join(marked, "doc_id").select("fold", "x", "y"), "labelled")
    size = len(model.weights)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The normal equations of a partition, one row for each row of the matrix; the last column is the right side."""
        total, seen = np.zeros((size, size + 1)), False
        for b in batches:
            if len(b):
                z, y = model.map(np.array(b["x"].tolist())), b["y"].to_numpy()
                total += np.hstack([z.T @ z, (z.T @ y)[:, None]])
                seen = True
        if seen:
            yield pd.DataFrame({"row": range(size), "v": list(total)})

    train = rows.filter("fold = 0").select("x", "y")
    parts = train.mapInPandas(sums, "row int, v array<double>").select("row", F.posexplode("v").alias("col", "v"))
    total = np.zeros((size, size + 1))
    for r in parts.groupBy("row", "col").agg(F.sum("v")).collect():
        total[r[0], r[1]] = r[2]
    if total[-1, -2] > 0 and total[-1, -1] in (0, total[-1, -2]):  # one class alone
        model.probability = np.full(2, total[-1, -1] / total[-1, -2])
        return model
    if total[-1, -2] > 0:  # raw scores count as they are until fold 2 calibrates them
        model.probability = np.array([0.0, 1.0])
        model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(size), total[:, -1])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"bin": np.minimum(BINS - 1, (model.raw(np.array(b["x"].tolist())) * BINS).astype(int)), "y": b["y"]})

    counts = rows.filter("fold = 2").select("x", "y").mapInPandas(raw, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count(F.lit(1))).orderBy("bin").collect()
    if counts:
        model.at, model.probability = isotonic(*(np.array(c, dtype=float) for c in ([(r[0] + 0.5) / BINS for r in counts], [r[1] for r in counts], [r[2] for r in counts])))
    return model


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    measured = common.cut(measure(docs, id_col, text_col), "statistics")
    model = fit(measured, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "score": model.score(np.array(b["x"].tolist()))})

    return common.map_frames(measured, run, "doc_id long, key binary, score double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Scores depend on the text alone. Null texts count as empty; empty texts are scored like any other by their
    statistics; rows with equal texts get equal scores; a null id is scored and not held out. An empty table
    gives no rows. What the driver collects has a fixed size: means, one matrix and BINS counts.
    """
    return _scored(docs, labels, id_col, text_col).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score() predicts to be good, with the columns of docs.

    A score depends on the text alone, so rejected texts are told by their hash; null and empty texts are judged
    like any other.
    """
    bad = common.cut(_scored(docs, labels, id_col, text_col).filter("score < 0.5").select(F.col("key").alias("__key")).distinct(), "rejected")
    own = docs.withColumn("__key", text_key(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return own.join(common.small(bad, BROADCAST_ROWS), "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
