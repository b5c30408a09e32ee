import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from hourglass.operators.panel import align_levels, drop_report
from hourglass.plans import global_model, gram, recursive, trees

BASE = dt.datetime(2024, 1, 1)


def optimal(X, y, weight, l1):
    """The optimality conditions of ``|y - Xw|^2 / (2 n) + l1 |w|_1`` on standardized inputs: the slope is l1 where the weight is not 0, and no larger elsewhere."""
    std = X.std(axis=0)
    Z = np.divide(X - X.mean(axis=0), std, out=np.zeros_like(X), where=std > 1e-9)
    slope = Z.T @ (y - y.mean() - Z @ weight) / len(y)
    used = np.abs(weight) > 0
    return np.allclose(slope[used], l1 * np.sign(weight[used]), atol=1e-6) and (np.abs(slope[~used]) <= l1 + 1e-6).all()


def test_all_targets_are_optimal_over_tiles_and_groups(spark, monkeypatch):
    """Several column blocks, runs and groups of targets; the targets lie in other tiles than the inputs, and one input is constant."""
    for name, value in (("WIDTH", 8), ("ROWS", 32), ("RUNS", 2), ("GROUP", 3)):
        monkeypatch.setattr(gram, name, value)
    rng = np.random.default_rng(3)
    n, p, s = 300, 13, 10
    X = rng.normal(size=(n, p)) * rng.uniform(0.1, 9, p) + 5
    X[:, 4] = 2.5
    Y = X @ (rng.normal(size=(p, s)) * (rng.random((p, s)) < 0.3)) + rng.normal(size=(n, s))
    df = spark.createDataFrame([(BASE + dt.timedelta(hours=i), X[i].tolist(), Y[i].tolist()) for i in range(n)], "ts timestamp, f array<double>, y array<double>").repartition(4)
    names = [f"s{k:02d}" for k in range(s)]
    models = {r.series: r for r in global_model.fit_targets(df, names, l1=0.2).collect()}
    assert sorted(models) == names
    for k, name in enumerate(names):
        m = models[name]
        assert m.horizon == k and m.n == n and optimal(X, Y[:, k], np.array(m.weight), 0.2), name
        std = X.std(axis=0)
        assert np.allclose(m.weight, np.array(m.coef) * np.where(std > 1e-9, std, 0.0)) and abs(m.intercept - (Y[:, k].mean() - X.mean(axis=0) @ m.coef)) < 1e-8
    z = np.concatenate([np.ones((n, 1)), X, Y], axis=1)
    numbered = df.select(F.monotonically_increasing_id().alias("number"), F.concat(F.array(F.lit(1.0)), "f", "y").alias("z"))
    whole = z.T @ z
    tiles = gram.gram_tiles(numbered).collect()
    assert len(tiles) == 6
    for t in tiles:
        want = whole[t.row * 8:t.row * 8 + 8, t.col * 8:t.col * 8 + 8]
        assert np.allclose(np.frombuffer(t.tile, np.float64).reshape(want.shape), want)


def test_jobs_do_not_grow_with_the_series(spark):
    def jobs(s):
        rng = np.random.default_rng(s)
        rows = [(BASE + dt.timedelta(hours=i), rng.normal(size=2 * s).tolist(), rng.normal(size=s).tolist()) for i in range(20)]
        df = spark.createDataFrame(rows, "ts timestamp, f array<double>, y array<double>")
        group = f"fit-{s}"
        spark.sparkContext.setJobGroup(group, group)
        global_model.fit_targets(df, [str(k) for k in range(s)], l1=0.5).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs(130) == jobs(2) > 0


def hourly(spark, values):
    rows = [(s, BASE + dt.timedelta(hours=h), v) for s, vs in values.items() for h, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def test_trees_learn_what_a_line_cannot(spark):
    """A parabola of the last value, which has no linear trend, in two series."""
    values = {"a": [3.0], "b": [4.1]}
    for out in values.values():
        for _ in range(599):
            out.append(3.9 * out[-1] * (1 - out[-1] / 10))
    p = hourly(spark, values)
    _, scores, importances = trees.fit_trees(p, trees=10, depth=3)
    linear = {r.series: r.mse for r in global_model.fit_global(p, l1=1e-3)[1].collect()}
    got = {r.series: r for r in scores.collect()}
    assert set(got) == {"a", "b"} and all(got[s].mse < 0.5 * linear[s] and got[s].n == 120 for s in got)
    imp = {r.feature: r.importance for r in importances.collect()}
    assert abs(sum(imp.values()) - 1) < 1e-6 and list(imp) == trees.FEATURES and imp["value_lag1"] > 0.2


def test_recursive_query_equals_the_rewriting_fill(spark):
    """Runs of one to six missing hours, a run at the start, a series without a value before a run, and one that ends early."""
    gaps = {5, 6, 7, 8, 9, 10, 20, 30, 31, 0, 1}
    values = {s: [None if h in gaps or (s == "b" and h in (4, 29)) else float(h + k) for h in range(40)] for k, s in enumerate("abc")}
    values["c"] = values["c"][:31]
    p = hourly(spark, values)
    model = spark.createDataFrame([("a", 0.5, 1.0), ("b", 2.0, 0.0), ("c", -1.0, 3.0)], "series string, slope double, intercept double")
    key = lambda df: sorted((r.step, r.series, r.ts, round(r.prediction, 9)) for r in df.collect())
    got = key(recursive.recursive_fill_lag1(p, model, steps=4))
    assert got == key(recursive.recursive_fill(p, recursive.lag1_predictor(model), steps=4)) and len(got) == 4 + 1 + 2 + 1 + 4 + 1 + 1
    assert recursive.recursive_fill_lag1(p.where("1 = 0"), model).count() == 0


def test_levels_are_aligned_and_nan_counts_as_dropped(spark):
    long = spark.createDataFrame([(1, "h_1", 1), (1, "h_2", 0), (2, "h_1", 0), (2, "h_2", 1)], "ts int, level string, flag int")
    assert sorted(tuple(r) for r in align_levels(long, ["h_0", "h_1", "h_2"]).collect()) == [(1, 0, 1, 0), (2, 0, 0, 1)]
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, None)], "a double, b int")
    assert tuple(drop_report(df, ["a", "b"]).first()) == (4, 1, 3)
