import numpy as np
import pytest

from hourglass.operators import joins
from hourglass.plans import conjugate, direct, kernel, lagmodels
from hourglass.sources import fixtures as fx
from tests.conftest import SF01

SAMPLES = "series string, window_id long, f array<double>, y array<double>"


def dense_ridge(X, Y, penalty):
    mx, my = X.mean(axis=0), Y.mean(axis=0)
    coef = np.linalg.solve((X - mx).T @ (X - mx) + np.diag(penalty), (X - mx).T @ (Y - my))
    return my - mx @ coef, coef


def make(seed, sizes, p, q):
    rng = np.random.default_rng(seed)
    return {s: (rng.normal(size=(n, p)) + 3, rng.normal(size=(n, q)) * 5) for s, n in sizes.items()}


def table(spark, data):
    rows = [(s, 3 * i, X[i].tolist(), Y[i].tolist()) for s, (X, Y) in data.items() for i in range(len(X))]
    return spark.createDataFrame(rows, SAMPLES).repartition(5)


def by_key(model, *cols):
    return {tuple(r[c] for c in cols): r for r in model.collect()}


def test_dual_and_primal_equal_a_dense_solve(spark, monkeypatch):
    """Series with fewer windows than inputs, more, one, and more than a block of windows."""
    monkeypatch.setattr(kernel, "WINDOWS", 16)
    p, q = 30, 2
    data = make(0, {"few": 12, "many": 70, "one": 1, "blocks": 29}, p, q)
    grid = joins.param_rows({"l2": [0.5, 4.0], "l2_attr": [0.5, 20.0]})
    model = by_key(kernel.fit_wide(table(spark, data), ["series"], p, q, [10, 20], ["l2", "l2_attr"], grid), "series", "config_id", "horizon")
    assert len(model) == 4 * 4 * q
    for s, (X, Y) in data.items():
        for c in grid:
            b0, coef = dense_ridge(X, Y, np.repeat([c["l2"], c["l2_attr"]], [10, 20]))
            for h in range(q):
                r = model[s, c["config_id"], h]
                assert np.allclose(r.coef, coef[:, h], atol=1e-9) and abs(r.intercept - b0[h]) < 1e-8 and r.n == len(X)
                assert np.allclose(r.fmean, X.mean(axis=0))


def test_leave_one_out_errors_equal_refits(spark):
    p, q = 9, 2
    data = make(1, {"a": 14, "b": 6, "c": 1}, p, q)
    grid = joins.param_rows({"l2": [0.3, 3.0, 30.0]})
    _, loo = kernel.fit_kernel(table(spark, data), ["series"], p, q, [p], ["l2"], grid)
    got = by_key(loo, "series", "config_id")
    for s, (X, Y) in data.items():
        for c in grid:
            if len(X) == 1:
                assert got[s, c["config_id"]].loo_mse is None
                continue
            errors = []
            for i in range(len(X)):
                keep = np.arange(len(X)) != i
                b0, coef = dense_ridge(X[keep], Y[keep], np.full(p, c["l2"]))
                errors.append(Y[i] - b0 - X[i] @ coef)
            assert abs(got[s, c["config_id"]].loo_mse - np.mean(np.square(errors))) < 1e-8


def test_one_decomposition_serves_the_grid(monkeypatch):
    calls = []
    eigh = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: calls.append(1) or eigh(m))
    X, Y = make(2, {"a": 40}, 8, 3)["a"]
    x, y = X.sum(axis=0), Y.sum(axis=0)
    stats = np.concatenate([[40], x, y, (X.T @ X)[np.triu_indices(8)], (X.T @ Y).ravel()])
    penalties = [np.full(8, l2) for l2 in (0.1, 1.0, 10.0, 100.0)]
    for penalty, (b0, coef) in zip(penalties, direct.solve_ridge(stats, 8, 3, penalties), strict=True):
        want = dense_ridge(X, Y, penalty)
        assert np.allclose(b0, want[0]) and np.allclose(coef, want[1])
    assert len(calls) == 1
    calls.clear()
    assert len(list(kernel.solve_dual([X @ X.T], Y, [[0.1], [1.0], [10.0]]))) == 3 and len(calls) == 1


def test_conjugate_gradients_equal_the_dense_solve(spark, monkeypatch):
    monkeypatch.setattr(kernel, "WINDOWS", 8)
    p, q = 10, 3
    data = make(3, {"a": 7, "b": 40, "c": 1}, p, q)
    data["flat"] = (data["a"][0], np.full((7, q), 7.0))  # nothing to explain
    model = by_key(conjugate.fit_conjugate(table(spark, data), ["series"], p, q, [4, 6], [0.5, 8.0]), "series", "horizon")
    for s, (X, Y) in data.items():
        b0, coef = dense_ridge(X, Y, np.repeat([0.5, 8.0], [4, 6]))
        for h in range(q):
            assert np.allclose(model[s, h].coef, coef[:, h], atol=1e-7) and abs(model[s, h].intercept - b0[h]) < 1e-6
    none = conjugate.fit_conjugate(table(spark, data).where("1 = 0"), ["series"], p, q, [4, 6], [0.5, 8.0])
    assert none.count() == 0
    with pytest.raises(ValueError):
        conjugate.fit_conjugate(table(spark, data), ["series"], p, q, [4, 6], [0.5, 0.0])


def test_full_calendar_input_both_ways(spark):
    """2,208 inputs of the fixture panel: two penalties by the dual form and by conjugate gradients agree to 1e-6, and with a dense solve."""
    panel = fx.panel_hourly(spark, SF01)
    dual, stats = lagmodels.fit_lags(panel, "hourly_two_family", l2=1.0, l2_attr=10.0)
    free, _ = lagmodels.fit_lags(panel, "hourly_two_family", l2=1.0, l2_attr=10.0, matrix_free=True)
    a, b = by_key(dual, "series", "horizon"), by_key(free, "series", "horizon")
    assert len(a) == len(b) == 20 and len(next(iter(a.values())).coef) == 2208
    for k in a:
        assert np.allclose(a[k].coef, b[k].coef, atol=1e-6) and abs(a[k].intercept - b[k].intercept) < 1e-6
    from pyspark.sql import functions as F

    from hourglass.operators import scale, windows
    w = scale.apply_scaler(windows.gap_windows(panel), stats)
    s = lagmodels.samples(w, "hourly_two_family", ["series"], 48, 4).where(F.col("series") == "click").orderBy("window_id").collect()
    X, Y = np.array([r.f for r in s]), np.array([r.y for r in s])
    assert X.shape == (9, 2208) and (X[:, 48:].reshape(9, 48, 45)[:, :, 2:26].sum(axis=2) == 1).all()
    b0, coef = dense_ridge(X, Y, np.repeat([1.0, 10.0], [48, 2160]))
    for h in range(4):
        assert np.allclose(a["click", h].coef, coef[:, h], atol=1e-8) and abs(a["click", h].intercept - b0[h]) < 1e-7
