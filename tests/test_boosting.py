"""Histogram boosting against a plain NumPy version that grows one leaf at a time."""

import math

import numpy as np
import pandas as pd
import pytest

from asof_spark.operators import boosting, models

COLUMNS = ("a", "b", "c")


def plain_tree(x, g, h, fit):
    """Leaf-wise growth on all rows: list of (rows, value)."""
    def best(rows):
        out = None
        for f in range(x.shape[1]):
            for b in range(int(x[:, f].max()) + 1):
                left = rows[x[rows, f] <= b]
                right = rows[x[rows, f] > b]
                if min(len(left), len(right)) < 20 or min(h[left].sum(), h[right].sum()) < 1e-3:
                    continue
                w = lambda r: g[r].sum() ** 2 / (h[r].sum() + fit.l2)
                gain = w(left) + w(right) - w(rows)
                if gain > 1e-12 and (out is None or gain > out[0] + 1e-9):
                    out = (gain, left, right)
        return out

    leaves = [np.arange(len(x))]
    splits = [best(leaves[0])]
    while len(leaves) < fit.leaves and any(splits):
        k = max((i for i, s in enumerate(splits) if s), key=lambda i: splits[i][0])
        _, left, right = splits[k]
        leaves[k : k + 1], splits[k : k + 1] = [left, right], [best(left), best(right)]
    return [(r, -fit.learning_rate * g[r].sum() / (h[r].sum() + fit.l2)) for r in leaves]


def binned(frame, edges):
    return np.stack([np.searchsorted(e, frame[c].to_numpy(float), "left") for c, e in zip(COLUMNS, edges)], 1)


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.normal(size=400).round(1), "b": rng.integers(0, 5, 400), "c": rng.normal(size=400).round(2)})
    y = (x.a + (x.b == 2) * 1.5 - x.c.abs() + rng.normal(size=400) > 0).astype("int32")
    return x.assign(home_win=y)[:300], x.assign(home_win=y)[300:]


@pytest.mark.parametrize("block_rows", [1 << 16, 90])
def test_losses_equal_plain_boosting(spark, frames, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 3)
    tune, val = (spark.createDataFrame(f) for f in frames)
    fits = [boosting.Fit(0.1, 4, 0.0), boosting.Fit(0.3, 8, 1.0), boosting.Fit(0.1, 2, 5.0)]
    got = boosting.boost(tune, val, fits, COLUMNS, 7, (1, 4, 7))
    assert got.keys() == {(k, n) for k in range(3) for n in (1, 4, 7)}
    edges = boosting.edges_of(tune, COLUMNS)
    x, held = binned(frames[0], edges), binned(frames[1], edges)
    y, y_held = frames[0].home_win.to_numpy(float), frames[1].home_win.to_numpy()
    for k, fit in enumerate(fits):
        raw = np.full(len(x), math.log(y.mean() / (1 - y.mean())))
        for done in range(1, 8):
            p = 1 / (1 + np.exp(-raw))
            tree = plain_tree(x, p - y, p * (1 - p), fit)
            assert len(tree) <= fit.leaves
            for rows, value in tree:
                raw[rows] += value
            if done in (1, 4, 7):
                # training scores of the fitted trees are the plain ones
                fitted = boosting.scores(x.astype(np.uint8), boosting.Fit(0, 0, 0, fit.trees[:done]), math.log(y.mean() / (1 - y.mean())))
                assert fitted == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)
                q = boosting.scores(held.astype(np.uint8), boosting.Fit(0, 0, 0, fit.trees[:done]), math.log(y.mean() / (1 - y.mean())))
                assert got[k, done] == pytest.approx(-np.log(np.where(y_held == 1, q, 1 - q)).mean(), abs=1e-9)


def test_grid_and_choice(spark, frames):
    tune, val = (spark.createDataFrame(f) for f in frames)
    grid = [{"learning_rate": r, "max_iter": n, "leaves": m, "l2": 0.0} for r in (0.1, 0.3) for n in (2, 5) for m in (3, 6)]
    found = models.search_boosted(tune, val, grid, COLUMNS).toPandas()
    assert len(found) == 8 and found.log_loss.between(0.3, 0.8).all()
    assert len(models.BOOSTED_GRID) == 54
    rows = [(0, 0.1, 400, 15, 0.0, 0.6801), (1, 0.05, 100, 31, 0.0, 0.6805), (2, 0.05, 100, 15, 0.0, 0.6815), (3, 0.03, 100, 15, 1.0, 0.6819), (4, 0.1, 100, 15, 1.0, 0.6803), (5, 0.03, 100, 15, 1.0, 0.6822)]
    table = spark.createDataFrame(rows, "config int, learning_rate double, max_iter int, leaves int, l2 double, log_loss double")
    assert models.select_config(table).first().config == 3


def test_empty_and_one_class(spark, frames):
    tune, val = (spark.createDataFrame(f) for f in frames)
    (loss,) = boosting.boost(tune.limit(0), val, [boosting.Fit(0.1, 4, 0.0)], COLUMNS, 1, (1,)).values()
    assert loss == pytest.approx(math.log(2))
    (loss,) = boosting.boost(tune.filter("home_win = 1"), val.filter("home_win = 1"), [boosting.Fit(0.1, 4, 0.0)], COLUMNS, 2, (2,)).values()
    assert loss < 1e-5


def test_some_hundred_thousand_rows_are_one_block(spark, monkeypatch):
    """A tree over rows that one task holds is no job for each of its levels, and its scores are those of the tree itself."""
    monkeypatch.setattr(boosting, "_advance", lambda *_: pytest.fail("a job for each level"))
    rows = spark.range(100_000).selectExpr("id % 97 / 97.0D as a", "cast(id % 5 as double) as b", "pmod(hash(id), 1000) / 1000.0D as c")
    rows = rows.selectExpr("a", "b", "c", "cast(a + c + b / 10 > 1.2 as int) as home_win")
    (fit,) = fits = [boosting.Fit(0.1, 9, 1.0)]
    losses = boosting.boost(rows, rows, fits, COLUMNS, 6, (2, 6))
    assert len(fit.trees) == 6 and losses[0, 6] < losses[0, 2] < math.log(2)


def test_rows_carried_down_a_tree_end_in_its_leaves():
    rng = np.random.default_rng(5)
    x, fit = rng.integers(0, 40, (3_000, 3)).astype(np.uint8), boosting.Fit(0.1, 7, 0.5)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 9) + rng.integers(0, 30, 3_000) > 45).astype(float)
    p = np.full(3_000, 0.5)
    nodes, wanted, node = [boosting._Node()], [0], np.zeros(3_000, np.int32)
    while wanted:
        sums = boosting._sums_at(x, p - y, p * (1 - p), boosting._slots(len(nodes), wanted)[node], len(wanted))
        assert np.array_equal(sums, boosting._histograms(x, y, np.zeros(3_000), boosting._arrays(nodes, None, fit), wanted))
        boosting._settle(nodes, wanted, boosting.best_splits(sums, fit.l2))
        since = len(nodes)
        wanted = boosting._grow(nodes, fit.leaves)
        node = boosting._step_down(x, node, nodes, since)
    used = boosting._chosen(nodes, fit.leaves)
    tree = boosting._arrays(nodes, used, fit)
    assert len(nodes) > 2 * len(used) + 1 and np.array_equal(boosting._ends(nodes, used)[node], boosting._leaf_of(x, tree))


def test_a_tree_sums_the_smaller_side_of_a_split(monkeypatch):
    """A deep tree reads its rows some times over, not once a level, and is the tree of whole levels; features of few bins share a column."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 200, (20_000, 3)), rng.integers(0, 3, (20_000, 3))], 1).astype(np.uint8)
    y, fit = (x[:, 0] / 100 + x[:, 3] * (x[:, 1] > 150) + rng.normal(size=20_000) > 1.5).astype(float), boosting.Fit(0.1, 31, 1.0)
    g, h = 0.5 - y, np.full(20_000, 0.25)
    packed, read = boosting._packed(x), []
    assert sorted(sorted(features) for _, features in packed) == [[0], [1], [2], [3, 4, 5]]
    whole = boosting._sums_at(x, g, h, np.zeros(20_000, np.int32), 1)[:, 0]
    assert np.allclose(boosting._sums_of(packed, g, h, None), whole, atol=1e-9)
    sums_of = boosting._sums_of
    monkeypatch.setattr(boosting, "_sums_of", lambda p, g, h, rows, *a: read.append(len(g) if rows is None else len(rows)) or sums_of(p, g, h, rows, *a))
    tree, leaves = boosting._best_first(np.ascontiguousarray(x.T), packed, g, h, whole[2], fit)
    nodes, wanted, node, levels = [boosting._Node()], [0], np.zeros(20_000, np.int32), 0
    while wanted:
        boosting._settle(nodes, wanted, boosting.best_splits(boosting._sums_at(x, g, h, boosting._slots(len(nodes), wanted)[node], len(wanted)), fit.l2))
        since, levels = len(nodes), levels + 1
        wanted = boosting._grow(nodes, fit.leaves)
        node = boosting._step_down(x, node, nodes, since)
    used = boosting._chosen(nodes, fit.leaves)
    values = boosting._arrays(nodes, used, fit)[4][boosting._ends(nodes, used)[node]]
    got = np.zeros(20_000)
    boosting._add_tree(got, np.ascontiguousarray(x.T), tree)
    assert len(leaves) == 31 and sum(map(len, leaves.values())) == 20_000 and np.allclose(got, values, atol=1e-12)
    assert levels > 5 and sum(read) < 4 * 20_000


def test_gains_that_differ_by_rounding_are_ties():
    """Two features that cut the rows alike, the second with sums of another order: the first one is split."""
    sums = np.zeros((3, 1, 2, boosting.BINS + 1))
    sums[:, 0, :, 3], sums[:, 0, :, 9] = np.array([[10.0], [25.0], [100]]), np.array([[-9.0], [25.0], [100]])
    sums[0, 0, 1, 3] += 1e-13
    ((_, split),) = boosting.best_splits(sums, 1.0)
    assert split[1:3] == (0, 3)
