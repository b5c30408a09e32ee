"""Errors, cross-validation scores and config selection.

The error the reference prints as "MAE" is a mean SQUARED error; it is
named ``mse`` here.  All aggregates are hash aggregates with map-side
partials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mse(pred: DataFrame, keys: Sequence[str] = ("series",), prediction: str = "prediction",
        target: str = "target") -> DataFrame:
    """Mean squared error per key; with ``keys=()`` one pooled error over all rows."""
    err = F.pow(F.col(prediction) - F.col(target), 2)
    return pred.groupBy(*keys).agg(F.avg(err).alias("mse"), F.count(err).alias("n"))


def cv_score(fold_mse: DataFrame, config_keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Unweighted mean of the fold errors per config, with their population std.

    A config without an error on some fold has a NULL score: it must not
    compete on fewer folds than the others.
    """
    whole = F.count("mse") == F.count(F.lit(1))
    return fold_mse.groupBy(*config_keys).agg(
        F.when(whole, F.avg("mse")).alias("mse"), F.stddev_pop("mse").alias("mse_std"),
        F.count("mse").alias("folds"))


def best_config(scores: DataFrame, score: str = "mse", key: str = "config_id") -> DataFrame:
    """The config with the least score; ties go to the lower ``key`` (the first tried).

    Configs without a score (NULL or NaN) cannot win; no row if none has one.
    """
    cols = scores.columns
    scored = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = scored.agg(F.min_by(F.struct(*cols), F.struct(F.col(score), F.col(key))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def sort_scores(scores: DataFrame, score: str = "mse", key: str = "config_id") -> DataFrame:
    return scores.orderBy(F.col(score).asc_nulls_last(), F.col(key))
