import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from hourglass.operators import joins, metrics, scale
from hourglass.plans import direct, recursive

BASE = dt.datetime(2024, 1, 1)


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("c", 5.0), ("c", 5.0)], "series string, value double")
    st = {r.series: r for r in scale.fit_scaler(df).collect()}
    assert st["a"].std == 1.0 and st["a"].mean == 2.0      # population std of {1, 3}
    assert st["c"].std == 1.0                                # constant series: std taken as 1
    s = scale.apply_scaler(df, scale.fit_scaler(df)).where("series = 'c'").collect()
    assert all(r.scaled == 0.0 for r in s)


def test_scaler_on_train_only_gives_zero_mean_unit_std(spark):
    rng = np.random.default_rng(1)
    rows = [("a", "x" if i < 80 else "y", float(v)) for i, v in enumerate(rng.normal(5, 2, 100))]
    df = spark.createDataFrame(rows, "series string, role string, value double")
    st = scale.fit_scaler(df, where=F.col("role") == "x")
    s = scale.apply_scaler(df, st).where("role = 'x'")
    r = s.agg(F.avg("scaled").alias("m"), F.stddev_pop("scaled").alias("s")).first()
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_linear_rule_recovered(spark):
    rng = np.random.default_rng(0)
    p, q, n = 6, 3, 400
    beta = rng.normal(size=(p, q))
    rows = []
    for s in ("a", "b"):
        X = rng.normal(size=(n, p))
        Y = X @ beta + (1.0 if s == "a" else -2.0)
        rows += [(s, i, X[i].tolist(), Y[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, window_id long, f array<double>, y array<double>").repartition(5)
    model = direct.fit_direct(df, ["series"], p, q, l2=1e-9)
    for r in model.collect():
        assert np.allclose(r.coef, beta[:, r.horizon], atol=1e-6)
        assert abs(r.intercept - (1.0 if r.series == "a" else -2.0)) < 1e-6
    pred = direct.predict_direct(df, model, ["series"], clip=False)
    assert pred.where(F.abs(F.col("prediction") - F.col("target")) > 1e-6).count() == 0


def test_lasso_zeroes_irrelevant_features_and_shrinks_by_the_penalty(spark):
    from hourglass.plans import global_model
    rng = np.random.default_rng(2)
    X = rng.normal(size=(500, 4))
    X[:, 3] = 1.0  # a constant input
    y0 = 3 * X[:, 0] + 0.01 * rng.normal(size=500)
    rows = [(BASE + dt.timedelta(hours=i), X[i].tolist(), [float(y0[i]), 7.0, float(-2 * X[i, 1])]) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, f array<double>, y array<double>")
    m = {r.series: r for r in global_model.fit_targets(df, ["a", "b", "c"], l1=0.1).collect()}
    # of a single strong input, lasso takes the standardized weight minus the penalty
    cov = np.cov(X[:, 0], y0, bias=True)[0, 1] / X[:, 0].std()
    assert abs(m["a"].weight[0] - (cov - 0.1)) < 2e-2
    assert all(abs(c) < 1e-3 for c in m["a"].coef[1:])
    assert abs(m["b"].intercept - 7) < 1e-6 and all(abs(c) < 1e-6 for c in m["b"].coef)  # a constant target
    assert m["c"].coef[1] < -1.8
    pred = global_model.predict_targets(df, spark.createDataFrame(list(m.values()), global_model.MODEL), 3).collect()
    assert len(pred) == 1500
    for r in pred[:50]:
        i = int((r.ts - BASE).total_seconds() // 3600)
        assert abs(r.prediction - (m[r.series].intercept + X[i] @ np.array(m[r.series].coef))) < 1e-9
        assert r.target == rows[i][2][r.horizon]


def test_targets_beyond_one_block_are_all_predicted(spark):
    from hourglass.plans import global_model
    n = global_model.BLOCK + 3
    model = spark.createDataFrame([(h // global_model.BLOCK, f"s{h:03d}", h, 0.0, float(h), [1.0], [1.0], 2) for h in range(n)], global_model.MODEL)
    df = spark.createDataFrame([(BASE, [0.5], [0.0] * n)], "ts timestamp, f array<double>, y array<double>")
    got = {r.horizon: r.prediction for r in global_model.predict_targets(df, model, n).collect()}
    assert got == {h: h + 0.5 for h in range(n)}
    empty = global_model.fit_targets(df.limit(0), ["a"])
    assert empty.count() == 0 and global_model.predict_targets(df, empty, 1).count() == 0


def test_recursive_fill_with_both_lags_of_all_series(spark):
    from hourglass.plans import global_model
    # a(t) = a(t-1) + b(t-2), b(t) = a(t-2)
    known = {"a": [1.0, 2.0, None, None, None], "b": [10.0, 20.0, None, None, None]}
    rows = [(s, BASE + dt.timedelta(hours=h), v) for s, vs in known.items() for h, v in enumerate(vs)]
    test = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    p = len(global_model.CALENDAR_FEATURES)
    unit = lambda *on: [1.0 if i - p in on else 0.0 for i in range(p + 4)]  # noqa: E731  # inputs: a1 b1 a2 b2
    model = spark.createDataFrame([(0, "a", 0, 0.0, 0.0, unit(0, 3), unit(0, 3), 1), (0, "b", 1, 0.0, 0.0, unit(2), unit(2), 1)], global_model.MODEL)
    out = recursive.recursive_fill(test, global_model.recursive_predictor(model, 2), steps=4, lags=(1, 2))
    got = sorted((r.step, r.series, r.ts.hour, r.prediction) for r in out.collect())
    assert got == [(1, "a", 2, 12.0), (1, "b", 2, 1.0), (2, "a", 3, 32.0), (2, "b", 3, 2.0), (3, "a", 4, 33.0), (3, "b", 4, 12.0)]


def test_calendar_layout_uses_the_attributes_of_each_target_hour(spark):
    from hourglass.functions.calendar import ATTRIBUTE_NAMES
    from hourglass.plans import lagmodels
    hours = [dt.datetime(2024, 1, 31, 22) + dt.timedelta(hours=h) for h in range(4)]  # crosses into February
    seq = spark.createDataFrame([("a", 0, [1.0], [5.0, 6.0, 7.0, 8.0], hours)],
                                "series string, window_id long, x array<double>, y array<double>, y_ts array<timestamp>")
    at = {n: 1 + i for i, n in enumerate(ATTRIBUTE_NAMES)}
    rows = sorted(lagmodels.features(seq, "two_family").collect(), key=lambda r: r.step)
    assert [r.y for r in rows] == [[5.0], [6.0], [7.0], [8.0]]
    assert [r.f[at["month_1"]] for r in rows] == [1, 1, 0, 0] and [r.f[at["month_2"]] for r in rows] == [0, 0, 1, 1]
    assert [next(h for h in range(24) if r.f[at[f"hour_{h}"]]) for r in rows] == [22, 23, 0, 1]


def test_attribution_against_brute_force(spark):
    from hourglass.plans import global_model
    rng = np.random.default_rng(5)
    X, coef, mean = rng.normal(size=(40, 3)), rng.normal(size=(2, 3)), rng.normal(size=3)
    s = spark.createDataFrame([("a", i, X[i].tolist()) for i in range(40)], "series string, window_id long, f array<double>")
    m = spark.createDataFrame([("a", h, coef[h].tolist(), mean.tolist()) for h in range(2)], "series string, horizon int, coef array<double>, fmean array<double>")
    want = np.abs((X - mean)[:, None, :] * coef[None]).mean(axis=(0, 1))
    got = global_model.attribution(s, m, ["series"], top=2).collect()
    assert {r.feature for r in got} == set(np.argsort(-want)[:2].tolist())
    assert all(abs(r.mean_abs_contribution - want[r.feature]) < 1e-9 for r in got)


def test_recursive_fill_fixed_coefficients(spark):
    # value(t) = 2 * value(t-1) + 1; rows 3..5 unknown -> 2*4+1=9, 19, 39
    rows = [("a", BASE + dt.timedelta(hours=h), v) for h, v in enumerate([1.0, 2.0, 4.0, None, None, None])]
    test = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    model = spark.createDataFrame([("a", 2.0, 1.0)], "series string, slope double, intercept double")
    out = recursive.recursive_fill(test, recursive.lag1_predictor(model), steps=4)
    got = sorted((r.step, r.ts.hour, r.prediction) for r in out.collect())
    assert got == [(1, 3, 9.0), (2, 4, 19.0), (3, 5, 39.0)]


def test_best_config_tie_goes_to_lower_id(spark):
    s = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, 0.5 + 0.5)], "config_id long, mse double")
    assert metrics.best_config(s).first().config_id == 1


def test_unscored_configs_never_win(spark):
    s = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "config_id long, mse double")
    assert metrics.best_config(s).first().config_id == 3
    assert metrics.best_config(s.where("config_id < 3")).count() == 0


def test_a_config_that_failed_on_a_fold_has_no_score(spark):
    f = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 2.0), (2, 1, 4.0)], "config_id long, fold int, mse double")
    assert {r.config_id: r.mse for r in metrics.cv_score(f).collect()} == {1: None, 2: 3.0}


def test_a_constant_series_is_forecast_by_its_mean(spark):
    from hourglass.plans.univariate import fit_univariate
    rows = [("a", w, [2.0] * 3, [5.0 + w]) for w in range(3)]
    m = fit_univariate(spark.createDataFrame(rows, "series string, window_id long, x array<double>, y array<double>")).collect()
    assert [(r.slope, r.intercept) for r in m] == [(0.0, 6.0)]


def test_infinite_values_are_not_masked(spark):
    from hourglass.functions.numeric import is_finite
    rows = spark.createDataFrame([(float("inf"),), (1.0,), (float("nan"),), (None,)], "x double")
    assert [r.ok for r in rows.select(is_finite("x").alias("ok")).collect()] == [True, True, False, False]


def test_param_grid_nested_order_and_skip(spark):
    g = joins.param_grid(spark, {"epochs": [50, 100], "lr": [0.001, 0.01]},
                         skip=lambda d: d["lr"] == 0.001 and d["epochs"] == 50)
    assert [(r.config_id, r.epochs, r.lr) for r in g.orderBy("config_id").collect()] == [
        (1, 50, 0.01), (2, 100, 0.001), (3, 100, 0.01)]


def test_holdout_scores_run_on_fixture(spark):
    from hourglass.plans import lagmodels
    from hourglass.sources import fixtures as fx
    from tests.conftest import SF01
    by_series, pooled = lagmodels.holdout_scores(fx.panel_hourly(spark, SF01), "lags", 24, 4, 5, l2=1.0)
    rows = by_series.collect()
    assert len(rows) == 5 and all(r.mse >= 0 for r in rows)
    p = pooled.first()
    assert p.n == sum(r.n for r in rows)
    assert abs(p.mse - sum(r.mse * r.n for r in rows) / p.n) < 1e-9


def test_scores_read_the_written_sequences(spark):
    """The windows are grouped into sequences once, while the plan is built; fit and scores read the result."""
    from hourglass.plans import forecast
    from hourglass.sources import fixtures as fx
    from tests.conftest import SF
    scores = forecast.univariate_scores(fx.panel_hourly(spark, SF), 24, 4, 5)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Relation [") == 2
