"""Per-series lag models: samples, final fit, test-block prediction, blocked CV.

Input layouts:

* ``lags``: the 48 scaled input values; one model per series for all horizons.
* ``hourly_calendar``: the 48 values and the 45 calendar attributes of each of
  the 48 input hours, 2,208 inputs with one penalty.
* ``hourly_two_family``: the same inputs; values and calendar carry separate
  penalties.
* ``lags_calendar``: the 48 values and the 45 attributes of the target hour.
  The attributes differ between horizons, so there is one model per series
  and horizon.
* ``two_family``: the same vector with separate penalties.

Layouts with a few dozen inputs are solved from sufficient statistics
(``hourglass.plans.direct``), the hourly ones window by window
(``hourglass.plans.kernel``) or by conjugate gradients
(``hourglass.plans.conjugate``).  Calendar attributes of input hours are
computed from the window's timestamps after the windows are gathered, so they
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.calendar import ATTRIBUTE_NAMES, attribute_columns
from hourglass.operators.joins import grid_rows
from hourglass.operators.metrics import cv_score, mse
from hourglass.operators.panel import drop_incomplete
from hourglass.operators.scale import apply_scaler, fit_scaler
from hourglass.operators.sequences import sequences
from hourglass.operators.windows import blocked_folds, gap_windows, test_blocks
from hourglass.plans import conjugate, direct, kernel
from hourglass.session import materialize

N_ATTR = len(ATTRIBUTE_NAMES)
HOURLY = ("hourly_calendar", "hourly_two_family")


def two_penalties(l2: float, l2_attr: float | None) -> list[dict]:
    """One config with a penalty for the values and one for the calendar."""
    return [{"config_id": 1, "l2": float(l2), "l2_attr": float(l2 if l2_attr is None else l2_attr)}]


def features(seq: DataFrame, layout: str) -> DataFrame:
    """Add the input vector ``f``; calendar layouts get one row per target hour, numbered ``step``."""
    if layout == "lags":
        return seq.withColumn("f", F.col("x"))
    if layout in HOURLY:
        hour = lambda t: F.array(*[c.cast("double") for c in attribute_columns(t)])
        return seq.withColumn("f", F.concat("x", F.flatten(F.transform("x_ts", hour)))).drop("x_ts")
    if layout in ("lags_calendar", "two_family"):
        hours = seq.select("*", F.posexplode("y_ts").alias("step", "_hour"))
        cal = F.array(*[c.cast("double") for c in attribute_columns("_hour")])
        return (hours.withColumn("f", F.concat(F.col("x"), cal))
                .withColumn("y", F.array(F.element_at("y", F.col("step") + 1)))
                .withColumn("y_ts", F.array("_hour")).drop("_hour"))
    raise ValueError(f"unknown layout {layout!r}")


def written(s: DataFrame, layout: str, window: str = "window_id") -> tuple[DataFrame, int | None]:
    """``(samples, number of windows)`` of samples that are read several times: written, without what ``f`` repeats.

    The hourly layouts, some 40 times as wide as their values, are not written (number None).
    """
    if layout in HOURLY:
        return s, None
    s = materialize(s.drop("x"), "samples")
    last = s.agg(F.max(window)).first()[0]
    return s, 0 if last is None else last + 1


def fit_layout(s: DataFrame, layout: str, keys: Sequence[str], train: int, predict: int, grid: DataFrame | list[dict] | None = None,
               l2: float = 1.0, windows: int | None = None) -> DataFrame:
    """Ridge models of a layout; those of the target-hour layouts are also keyed by ``step`` and have one horizon."""
    p, families, penalties = width(layout, train)
    if layout in HOURLY:
        return kernel.fit_wide(s, keys, p, predict, families, penalties, grid, l2)
    if layout != "lags":
        keys, predict = [*keys, "step"], 1
    return direct.fit_direct(s, keys, p, predict, grid=grid, l2=l2, families=families, param_cols=penalties, window="window_id", windows=windows)


def predict_layout(s: DataFrame, model: DataFrame, layout: str, keys: Sequence[str], window: str = "window_id",
                   clip: bool = True, windows: int | None = None) -> DataFrame:
    """``(keys, params, window, horizon, ts, prediction, target)`` with the models of ``fit_layout``."""
    if layout == "lags" or layout in HOURLY:
        pred = direct.predict_direct(s, model, keys, window, clip, carry=["y_ts"], windows=windows)
        at = F.col("horizon")
    else:
        pred = direct.predict_direct(s, model, [*keys, "step"], window, clip, carry=["y_ts"], windows=windows)
        pred, at = pred.drop("horizon").withColumnRenamed("step", "horizon"), F.lit(0)
    return pred.withColumn("ts", F.element_at("y_ts", at + 1)).drop("y_ts")


def width(layout: str, train: int) -> tuple[int, list[int] | None, list[str]]:
    """Feature count, family sizes and penalty columns of a layout."""
    if layout == "lags":
        return train, None, ["l2"]
    if layout in HOURLY:
        size = train * (1 + N_ATTR)
        return (size, None, ["l2"]) if layout == "hourly_calendar" else (size, [train, train * N_ATTR], ["l2", "l2_attr"])
    if layout == "lags_calendar":
        return train + N_ATTR, None, ["l2"]
    return train + N_ATTR, [train, N_ATTR], ["l2", "l2_attr"]


def samples(scaled: DataFrame, layout: str, keys: Sequence[str], train: int, predict: int,
            window: str = "window_id") -> DataFrame:
    seq = sequences(scaled, keys=keys, window=window, train=train, predict=predict, target_ts="ts",
                    input_ts="ts" if layout in HOURLY else None)
    return features(seq, layout)


def fit_lags(panel: DataFrame, layout: str = "lags", train: int = 48, predict: int = 4, gap: int = 26,
             l2: float = 1.0, l2_attr: float | None = None, matrix_free: bool = False):
    """Final per-series model on every window of the complete panel.

    Returns ``(model, scaler_stats)``.  Inputs are scaled with training
    statistics; targets stay raw.  ``matrix_free`` solves by conjugate
    gradients.
    """
    w = materialize(gap_windows(drop_incomplete(panel), train, predict, gap))
    stats = fit_scaler(w, where=F.col("role") == "x")
    s = samples(apply_scaler(w, stats), layout, ["series"], train, predict)
    grid = two_penalties(l2, l2_attr) if layout.endswith("two_family") else None
    if matrix_free:
        p, families, penalties = width(layout, train)
        if layout in ("lags_calendar", "two_family"):
            raise ValueError("conjugate gradients take layouts with one model for all horizons")
        return conjugate.fit_conjugate(s, ["series"], p, predict, families or [p], [grid[0][c] if grid else l2 for c in penalties]), stats
    s, n = written(s, layout)
    return fit_layout(s, layout, ["series"], train, predict, grid, l2, n), stats


def predict_blocks(test: DataFrame, model: DataFrame, stats: DataFrame, layout: str = "lags",
                   history: int = 48, predict: int = 4, clip: bool = True) -> DataFrame:
    """Apply trained models to test blocks (48 known rows + 4 targets) with the TRAIN scaler.

    Returns ``(series, block_id, horizon, ts, prediction)``.
    """
    b = test_blocks(test, history, predict)
    x = (apply_scaler(b, stats)
         .withColumnsRenamed({"block_offset": "offset"}))
    s, n = written(samples(x, layout, ["series"], history, predict, window="block_id"), layout, "block_id")
    pred = predict_layout(s, model, layout, ["series"], "block_id", clip, n)
    return pred.select("series", "block_id", "horizon", "ts", "prediction")


def cross_validate(panel: DataFrame, grid: DataFrame | list[dict], layout: str = "lags", train: int = 24,
                   predict: int = 4, gap: int = 5, k: int = 4, train_share: float = 0.8,
                   complete_only: bool = True):
    """Blocked k-fold scores for every config of ``grid``.

    Per fold and series: scaler on the fold's training inputs, one fit per
    config on the fold's training windows (statistics shared by all
    configs), prediction of the validation windows, squared errors pooled
    over series per (config, fold), then the unweighted mean over folds.
    Returns ``(fold_mse, scores)``.
    """
    p0 = drop_incomplete(panel) if complete_only else panel
    w = materialize(blocked_folds(gap_windows(p0, train, predict, gap), k, train_share))
    keys = ["series", "fold"]
    stats = fit_scaler(w, keys=keys, where=(F.col("role") == "x") & (F.col("fold_role") == "train"))
    s, n = written(samples(apply_scaler(w, stats, keys=keys), layout, keys + ["fold_role"], train, predict), layout)
    model = fit_layout(s.where(F.col("fold_role") == "train"), layout, keys, train, predict, grid, windows=n)
    pred = predict_layout(s.where(F.col("fold_role") == "val").drop("fold_role"), model, layout, keys, windows=n)
    cfg = list(grid_rows(grid)[0])
    fold_mse = mse(pred, cfg + ["fold"])
    return fold_mse, cv_score(fold_mse, cfg)


def leave_one_out(panel: DataFrame, grid: DataFrame | list[dict], layout: str = "lags", train: int = 48, predict: int = 4, gap: int = 26) -> DataFrame:
    """Mean squared leave-one-window-out error per series and config, ``(series, config columns, loo_mse, n)``, not clipped.

    The inputs are scaled once, with all windows.  It takes the windows-by-windows
    form, whose size grows with the windows of a series: for series with more
    windows than inputs use ``cross_validate``; such series raise an error.
    """
    p, families, penalties = width(layout, train)
    if layout in ("lags_calendar", "two_family"):
        raise ValueError("layouts with one model per horizon have no windows-by-windows form here")
    w = materialize(gap_windows(drop_incomplete(panel), train, predict, gap))
    s = materialize(samples(apply_scaler(w, fit_scaler(w, where=F.col("role") == "x")), layout, ["series"], train, predict))
    most = s.groupBy("series").count().agg(F.max("count")).first()[0] or 0
    if most > max(p, kernel.WINDOWS):
        raise ValueError(f"a series has {most} windows, more than its {p} inputs")
    return kernel.fit_kernel(s, ["series"], p, predict, families or [p], penalties, grid_rows(grid))[1]


def holdout_scores(panel: DataFrame, layout: str = "lags", train: int = 48, predict: int = 4, gap: int = 26,
                   frac: float = 0.8, l2: float = 1.0, l2_attr: float | None = None):
    """Chronological holdout: first ``frac`` of the windows train, the rest score.

    The scaler and the models use the training windows only.  Returns
    ``(mse_by_series, pooled_mse)``; the pooled error is over all series'
    validation rows together, not a mean of per-series errors.
    """
    from hourglass.operators.windows import split_windows
    w = materialize(split_windows(gap_windows(drop_incomplete(panel), train, predict, gap), frac))
    stats = fit_scaler(w, where=(F.col("role") == "x") & (F.col("split") == "train"))
    s, n = written(samples(apply_scaler(w, stats), layout, ["series", "split"], train, predict), layout)
    grid = two_penalties(l2, l2_attr) if layout.endswith("two_family") else None
    model = fit_layout(s.where(F.col("split") == "train").drop("split"), layout, ["series"], train, predict, grid, l2, n)
    pred = predict_layout(s.where(F.col("split") == "val").drop("split"), model, layout, ["series"], windows=n)
    return mse(pred, ["series"]), mse(pred, [])
