"""Per (series, horizon) least squares on one summary of the input window.

Built-in aggregates only (``covar_pop`` / ``var_pop`` / ``avg`` have
mergeable partial states), so the fit is one hash aggregation keyed by
``(series, horizon)`` with map-side partials: a hot series costs nothing
extra.  An optional ridge penalty ``l2`` shrinks the slope:
``slope = S_xy / (S_xx + l2)``; with ``l2 = 0`` it is ``regr_slope``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.functions.numeric import clip_floor
from hourglass.operators.joins import per_key_join
from hourglass.operators.metrics import cv_score, mse
from hourglass.operators.panel import drop_incomplete
from hourglass.operators.scale import apply_scaler, fit_scaler
from hourglass.operators.sequences import sequences
from hourglass.operators.windows import blocked_folds, gap_windows, test_blocks
from hourglass.session import materialize


def window_summary(x: Column, kind: str | Column = "mean") -> Column:
    """One number per input window: its mean or its last value (``kind`` may be a column)."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    last = F.element_at(x, -1)
    if isinstance(kind, Column):
        return F.when(kind == "last", last).otherwise(mean)
    if kind == "mean":
        return mean
    if kind == "last":
        return last
    raise ValueError(f"unknown summary {kind!r}")


def horizon_rows(seq: DataFrame, keys: Sequence[str] = ("series",), window: str = "window_id",
                 kind: str | Column = "mean") -> DataFrame:
    """``(keys, window, horizon, feature, target)``: one row per target hour of each window."""
    return seq.select(*keys, window, window_summary(F.col("x"), kind).alias("feature"),
                      F.posexplode("y").alias("horizon", "target"))


def _fit(rows: DataFrame, keys: Sequence[str], l2: float | str = 0.0) -> DataFrame:
    ok = rows.where(F.col("feature").isNotNull() & F.col("target").isNotNull())
    pen = F.col(l2) if isinstance(l2, str) else F.lit(float(l2))
    g = ok.groupBy(*keys, "horizon")
    if isinstance(l2, str):
        g = ok.groupBy(*keys, l2, "horizon")
    agg = g.agg(F.count(F.lit(1)).alias("_n"), F.covar_pop("target", "feature").alias("_cxy"),
                F.var_pop("feature").alias("_vx"), F.avg("feature").alias("_mx"),
                F.avg("target").alias("_my"))
    den = F.col("_vx") * F.col("_n") + pen
    slope = F.when(den != 0, F.col("_cxy") * F.col("_n") / den).otherwise(0.0)  # a constant feature predicts the mean
    return (agg.withColumn("slope", slope)
            .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
            .drop("_n", "_cxy", "_vx", "_mx", "_my"))


def fit_univariate(seq: DataFrame, keys: Sequence[str] = ("series",), window: str = "window_id",
                   kind: str = "mean", l2: float = 0.0) -> DataFrame:
    """Model table ``(keys, horizon, slope, intercept)``."""
    return _fit(horizon_rows(seq, keys, window, kind), keys, l2)


def predict_univariate(seq: DataFrame, model: DataFrame, keys: Sequence[str] = ("series",),
                       window: str = "window_id", kind: str = "mean", clip: bool = True) -> DataFrame:
    """``(keys, window, horizon, prediction, target)``; predictions clipped at 0 by default."""
    rows = horizon_rows(seq, keys, window, kind)
    p = F.col("intercept") + F.col("slope") * F.col("feature")
    return (per_key_join(rows, model, [*keys, "horizon"])
            .select(*keys, window, "horizon", (clip_floor(p) if clip else p).alias("prediction"),
                    "target"))


def train_univariate(panel: DataFrame, train: int = 48, predict: int = 4, gap: int = 26,
                     kind: str = "mean", l2: float = 0.0):
    """Final model on all windows of the complete panel: ``(model, scaler_stats)``."""
    w = materialize(gap_windows(drop_incomplete(panel), train, predict, gap))
    stats = fit_scaler(w, where=F.col("role") == "x")
    seq = sequences(apply_scaler(w, stats), train=train, predict=predict)
    return fit_univariate(seq, kind=kind, l2=l2), stats


def predict_blocks_univariate(test: DataFrame, model: DataFrame, stats: DataFrame, history: int = 48,
                              predict: int = 4, kind: str = "mean", clip: bool = True) -> DataFrame:
    """Test blocks scaled with TRAIN statistics -> ``(series, block_id, horizon, ts, prediction)``."""
    b = test_blocks(test, history, predict)
    x = apply_scaler(b, stats).withColumnRenamed("block_offset", "offset")
    seq = sequences(x, window="block_id", train=history, target_ts="ts")
    feats = seq.select("series", "block_id", window_summary(F.col("x"), kind).alias("feature"),
                       F.posexplode("y_ts").alias("horizon", "ts"))
    p = F.col("intercept") + F.col("slope") * F.col("feature")
    return per_key_join(feats, model, ["series", "horizon"], "inner").select(
        "series", "block_id", "horizon", "ts", (clip_floor(p) if clip else p).alias("prediction"))


def cross_validate_univariate(panel: DataFrame, grid: DataFrame, train: int = 24, predict: int = 4,
                              gap: int = 5, k: int = 4, train_share: float = 0.8,
                              complete_only: bool = True):
    """Blocked k-fold scores of the univariate model over a grid with ``kind`` and ``l2`` columns.

    Both window summaries are computed once per window; the training
    statistics are aggregated per (series, fold, horizon) BEFORE the grid is
    attached, so configs multiply only those summaries and the scored
    validation rows.  Returns ``(fold_mse, scores)``; errors are pooled over
    series per (config, fold).
    """
    from hourglass.operators.joins import grid_rows, with_grid
    grid = grid_rows(grid)
    p0 = drop_incomplete(panel) if complete_only else panel
    w = materialize(blocked_folds(gap_windows(p0, train, predict, gap), k, train_share))
    keys = ["series", "fold"]
    stats = fit_scaler(w, keys=keys, where=(F.col("role") == "x") & (F.col("fold_role") == "train"))
    seq = sequences(apply_scaler(w, stats, keys=keys), keys=keys + ["fold_role"], train=train, predict=predict)
    rows = seq.select(*keys, "fold_role", "window_id",
                      window_summary(F.col("x"), "mean").alias("f_mean"),
                      window_summary(F.col("x"), "last").alias("f_last"),
                      F.posexplode("y").alias("horizon", "target"))
    tr = rows.where((F.col("fold_role") == "train") & F.col("target").isNotNull())
    aggs = []
    for kind in ("mean", "last"):
        f = F.col(f"f_{kind}")
        ok = F.when(f.isNotNull(), F.col("target"))
        aggs += [F.count(ok).alias(f"n_{kind}"), F.covar_pop(ok, f).alias(f"cxy_{kind}"),
                 F.var_pop(F.when(ok.isNotNull(), f)).alias(f"vx_{kind}"),
                 F.avg(F.when(ok.isNotNull(), f)).alias(f"mx_{kind}"), F.avg(ok).alias(f"my_{kind}")]
    suff = tr.groupBy(*keys, "horizon").agg(*aggs)
    cfg_cols = list(grid[0])
    pick = lambda name: F.when(F.col("kind") == "last", F.col(f"{name}_last")).otherwise(F.col(f"{name}_mean"))
    den = pick("vx") * pick("n") + F.col("l2")
    slope = F.when(den != 0, pick("cxy") * pick("n") / den).otherwise(0.0)
    model = (with_grid(suff, grid)
             .select(*keys, *cfg_cols, "horizon", slope.alias("slope"), pick("mx").alias("_mx"),
                     pick("my").alias("_my"))
             .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).drop("_mx", "_my"))
    va = rows.where(F.col("fold_role") == "val")
    feat = F.when(F.col("kind") == "last", F.col("f_last")).otherwise(F.col("f_mean"))
    p = F.col("intercept") + F.col("slope") * feat
    pred = per_key_join(va, model, keys + ["horizon"], "inner").select(
        *keys, *cfg_cols, "window_id", "horizon", clip_floor(p).alias("prediction"), "target")
    fold_mse = mse(pred, cfg_cols + ["fold"])
    return fold_mse, cv_score(fold_mse, cfg_cols)
