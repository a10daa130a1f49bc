"""Logistic fits in shared passes, Platt calibration and imputation against plain NumPy and MLlib."""

import numpy as np
import pandas as pd
import pytest

from asof_spark.operators import models
from asof_spark.operators.newton import Fit, fit_many, metrics_many

COLUMNS = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(500, 3)) * [1, 5, 0.2], columns=list("abc")).assign(d=2.0)
    y = (x.a - 0.3 * x.b + rng.logistic(size=500) > 0.4).astype("int32")
    other = pd.array(np.where(rng.random(500) < 0.2, None, 1 - y), dtype="Int32")
    return x.assign(home_win=y, other=other)[:400], x.assign(home_win=y, other=other)[400:]


def plain_fit(x, y, c, steps=100):
    """Newton steps on all rows; columns scaled by their sample deviation, a constant one to 0."""
    mean, dev = x.mean(0), x.std(0, ddof=1)
    z = np.hstack([np.where(dev > 0, (x - mean) / np.where(dev > 0, dev, 1), 0), np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1 / c), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return w


def test_fits_equal_numpy_and_mllib(spark, frames):
    train, test = (spark.createDataFrame(f) for f in frames)
    fits = [Fit("all", COLUMNS), Fit("strong", COLUMNS, 0.01), Fit("one", ("b",)), Fit("weak", ("a", "c"), 1000.0), Fit("other", ("a", "b"), 1.0, "other")]
    fitted = fit_many(train.repartition(3), fits)
    for k, f in enumerate(fits):
        rows = frames[0].dropna(subset=[f.label])
        mean, dev = frames[0][list(f.columns)].mean(), frames[0][list(f.columns)].std()
        if f.label == "home_win":
            want = plain_fit(rows[list(f.columns)].to_numpy(), rows[f.label].to_numpy(float), f.c)
            assert [fitted.coefficients(k)[c] for c in f.columns] == pytest.approx(want[:-1], abs=1e-7)
            assert fitted.weights[k, -1] == pytest.approx(want[-1], abs=1e-7)
            stages = models.fit_logistic(train, f.columns, f.c).stages
            assert [fitted.coefficients(k)[c] for c in f.columns] == pytest.approx(stages[-1].coefficients.toArray(), abs=1e-4)
        p = np.array([r.p for r in fitted.predict(test, k).collect()])
        z = sum((fitted.coefficients(k)[c] * (frames[1][c] - mean[c]) / (dev[c] or 1) for c in f.columns), fitted.weights[k, -1])
        assert p == pytest.approx((1 / (1 + np.exp(-z))).to_numpy(), abs=1e-9)
        y = frames[1][f.label].astype(float).to_numpy()
        known = ~np.isnan(y)
        m = metrics_many(test, fitted)[k]
        assert m["n"] == known.sum() and m["accuracy"] == pytest.approx(((p > 0.5) == (y == 1))[known].mean())
        assert m["log_loss"] == pytest.approx(-np.log(np.where(y == 1, p, 1 - p))[known].mean())


def test_separable_rows_end(spark):
    rows = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "a double, home_win int")
    fitted = fit_many(rows, [Fit("x", ("a",), 1000.0)])
    want = plain_fit(np.arange(100.0)[:, None], (np.arange(100) >= 50).astype(float), 1000.0)
    assert fitted.weights[0] == pytest.approx(want, rel=1e-6)


def test_no_rows_and_one_class(spark):
    none = spark.createDataFrame([], "a double, home_win int")
    fitted = fit_many(none, [Fit("x", ("a",))])
    assert not fitted.weights.any() and metrics_many(none, fitted)[0] == {"n": 0, "accuracy": None, "log_loss": None}
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, home_win int")
    assert metrics_many(rows, fit_many(rows, [Fit("x", ("a",))]))[0]["accuracy"] == 1.0


def test_platt_equals_a_plain_sigmoid_fit(spark, frames):
    train, val = (spark.createDataFrame(f) for f in frames)
    base = models.fit_logistic(train, ("a", "b"))
    got = models.platt(base, val)(val).collect()
    raw = np.array([r.raw_p for r in got])
    margin, y = np.log(raw / (1 - raw)), frames[1].home_win.to_numpy(float)
    z, w = np.stack([margin, np.ones(len(y))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (p - y))
    assert [r.p for r in got] == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=1e-4)


def test_imputed_fit_equals_a_fit_on_medians(spark, frames):
    holed = frames[0].assign(a=np.where(np.arange(400) % 7 == 0, np.nan, frames[0].a))
    model = models.fit_logistic(spark.createDataFrame(holed), ("a", "b"), impute=True)
    median = spark.createDataFrame(holed).selectExpr("percentile_approx(nanvl(a, null), 0.5, 10000)").first()[0]
    want = plain_fit(holed.fillna({"a": median})[["a", "b"]].to_numpy(), holed.home_win.to_numpy(float), 1.0)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(want[:-1], abs=1e-3)
