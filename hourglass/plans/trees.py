"""Non-linear model of all series: boosted trees over pooled samples.

One ``pyspark.ml`` gradient-boosted ensemble is fitted for all series
together: a sample is one hour of one series, with the calendar of the hour,
the two lags of the series, the two lags averaged over all series and the
series' training mean.  So the number of jobs depends on the trees and their
depth and not on the number of series, and a new series can be predicted too.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import hourglass.functions.calendar as cal
from hourglass.operators.joins import per_key_join
from hourglass.operators.lags import lag_features
from hourglass.operators.metrics import mse
from hourglass.operators.windows import split_rows
from hourglass.session import materialize

OWN = ["value_lag1", "value_lag2", "all_lag1", "all_lag2", "series_mean"]


def _calendar(t: Column) -> dict[str, Column]:
    out = {f"hour_{h}": (F.hour(t) == h).cast("double") for h in cal.HOUR_DOMAIN}
    out |= {f"month_{m}": (F.month(t) == m).cast("double") for m in cal.MONTH_DOMAIN}
    return out | {"is_weekend": cal.is_weekend(t).cast("double"), "is_holiday": (cal.fixed_holiday(t) | cal.easter_holiday(t)).cast("double"),
                  "is_school_holiday": cal.school_holiday(t).cast("double")}


FEATURES = [*[f"hour_{h}" for h in cal.HOUR_DOMAIN], *[f"month_{m}" for m in cal.MONTH_DOMAIN], "is_weekend", "is_holiday", "is_school_holiday", *OWN]


def pooled_samples(panel: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """``(series, ts, split, value, features...)``: hours at which the series has a value and both lags.

    The first ``train_frac`` of the timestamps train; a series without a
    training value is left out.
    """
    lagged = materialize(split_rows(lag_features(panel, [1, 2]), train_frac), "tree-rows")
    hours = lagged.groupBy("ts").agg(F.avg("value_lag1").alias("all_lag1"), F.avg("value_lag2").alias("all_lag2"))
    means = lagged.where("split = 'train'").groupBy("series").agg(F.avg("value").alias("series_mean"))
    whole = F.col("value").isNotNull() & F.col("value_lag1").isNotNull() & F.col("value_lag2").isNotNull() & F.col("series_mean").isNotNull()
    rows = per_key_join(lagged.join(hours, "ts"), means, ["series"], "inner").where(whole)
    return rows.select("series", "ts", "split", "value", *[c.alias(n) for n, c in _calendar(F.col("ts")).items()], *OWN)


def fit_trees(panel: DataFrame, train_frac: float = 0.8, trees: int = 20, depth: int = 4, seed: int = 7):
    """Boosted trees on the first ``train_frac`` of the timestamps; ``(model, held-out mse by series, importances)``.

    Predictions are clipped at 0.  ``importances`` are ``(feature,
    importance)``, adding up to 1.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(pooled_samples(panel, train_frac))
    rows = materialize(rows.select("series", "ts", "split", "value", "features"), "tree-samples")
    gbt = GBTRegressor(labelCol="value", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, subsamplingRate=1.0, checkpointInterval=10)
    model = gbt.fit(rows.where("split = 'train'"))
    scored = model.transform(rows.where("split = 'val'")).select("series", F.greatest("prediction", F.lit(0.0)).alias("prediction"), F.col("value").alias("target"))
    weights = model.featureImportances.toArray()
    importances = panel.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(FEATURES, weights, strict=True)], "feature string, importance double")
    return model, mse(scored, ["series"]), importances
