"""AUC and percentiles by ranges of equally many distinct values, against NumPy, on values that lie close together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from asof_spark.operators import metrics


def plain_auc(y, p):
    order = np.argsort(p, kind="stable")
    values, start, count = np.unique(p[order], return_index=True, return_counts=True)
    rank = dict(zip(values, start + (count + 1) / 2))
    ranks = np.array([rank[v] for v in p])
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


@pytest.fixture(scope="module")
def close():
    """Nearly all values lie in one of 16,384 equal ranges, some far off."""
    rng = np.random.default_rng(2)
    p = np.concatenate([0.5 + rng.integers(0, 4000, 6000) * 1e-9, [0.0, 1.0, 0.9, 0.9]])
    return (rng.random(len(p)) < 0.5 + (p - 0.5) * 2e4).astype(int), p


def test_auc_of_close_values(spark, close):
    rows = spark.createDataFrame([(int(a), float(b), "x" if i % 2 else None) for i, (a, b) in enumerate(zip(*close))], "y int, p double, g string")
    assert metrics.auc(rows).first().auc == pytest.approx(plain_auc(*close), abs=1e-12)
    got = {r.g: r.auc for r in metrics.auc(rows, "g").collect()}
    odd = np.arange(len(close[0])) % 2 == 1
    assert got == {"x": pytest.approx(plain_auc(close[0][odd], close[1][odd])), None: pytest.approx(plain_auc(close[0][~odd], close[1][~odd]))}


def test_no_range_holds_many_values(spark, close):
    cells = spark.createDataFrame([(float(v),) for v in np.unique(close[1])], "p double")
    placed = metrics.with_range(cells, "p")
    assert placed.groupBy("__at").count().agg(F.max("count")).first()[0] <= 20
    pairs = [(r.p, r["__at"]) for r in placed.orderBy("p").collect()]
    assert len(pairs) > 2000 and [a for _, a in pairs] == sorted(a for _, a in pairs)


def test_percentiles_of_close_values(spark, close):
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    skewed = np.exp(np.random.default_rng(1).normal(size=3000) * 8)
    rows = [("close", float(v)) for v in close[1]] + [("skewed", float(v)) for v in skewed] + [("one", 3.0)] * 5 + [("none", None)]
    got = {r["name"]: r.q for r in metrics.percentiles(spark.createDataFrame(rows, "name string, value double"), at).collect()}
    assert got.keys() == {"close", "skewed", "one"}
    assert got["close"] == pytest.approx(np.percentile(close[1], [100 * a for a in at]), abs=1e-15)
    assert got["skewed"] == pytest.approx(np.percentile(skewed, [100 * a for a in at]), rel=1e-12)
    assert got["one"] == [3.0] * len(at)


def test_nulls_nan_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (0, float("nan")), (1, 0.2), (0, 0.1)], "y int, p double")
    assert metrics.auc(rows).count() == 1
    assert metrics.auc(rows.limit(0)).first().auc is None
    assert metrics.percentiles(spark.createDataFrame([], "name string, value double"), [0.5]).count() == 0
