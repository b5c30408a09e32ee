"""Standardization with training statistics only.

Population standard deviation, and a zero (or undefined) deviation is
replaced by 1, as the common scaler of the reference does.  The state is a
DataFrame ``(keys..., n, mean, std)``: joined, never held on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.operators.joins import per_key_join
from hourglass.operators.panel import q

# Deviations at or below this are treated as zero (the scale becomes 1).
ZERO_STD = 1e-12


def _safe_std(c: Column) -> Column:
    return F.when(c.isNull() | (c <= F.lit(ZERO_STD)), F.lit(1.0)).otherwise(c)


def fit_scaler(x: DataFrame, keys: Sequence[str] = ("series",), value: str = "value",
               where: Column | None = None) -> DataFrame:
    """Per-key mean and population std of ``value`` over the rows selected by ``where``.

    A hash aggregate with map-side partials: a hot key costs one partial row
    per task, not a large group.
    """
    src = x if where is None else x.where(where)
    return (src.groupBy(*keys)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                 _safe_std(F.stddev_pop(value)).alias("std")))


def apply_scaler(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ("series",),
                 value: str = "value", out: str = "scaled") -> DataFrame:
    """``(value - mean) / std`` with the statistics of ``stats`` (salted join on ``keys``: a hot key is split)."""
    s = stats.select(*keys, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return (per_key_join(df, s, keys)
            .withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_std"))
            .drop("_mean", "_std"))


def invert_scaler(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ("series",),
                  col: str = "prediction", out: str | None = None) -> DataFrame:
    """``col * std + mean``: back to the original unit."""
    s = stats.select(*keys, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return (per_key_join(df, s, keys)
            .withColumn(out or col, F.col(col) * F.col("_std") + F.col("_mean"))
            .drop("_mean", "_std"))


def fit_scaler_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std of every feature column, in ONE aggregation, as rows ``(feature, mean, std)``."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(q(c)).cast("double")).alias(f"m{len(aggs)}"),
                 F.stddev_pop(F.col(q(c)).cast("double")).alias(f"m{len(aggs) + 1}")]
    one = df.agg(*aggs)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"m{2 * i}").alias("mean"),
                      _safe_std(F.col(f"m{2 * i + 1}")).alias("std"))
             for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*pairs)))


def apply_scaler_matrix(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale every feature column with a one-row-per-feature statistics table.

    The statistics (one entry per feature, a size fixed by the model
    width) become one map-valued scalar subquery.
    """
    m = stats.select(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("mean", "std"))))).scalar()
    return df.withColumns({c: (F.col(q(c)).cast("double") - m[c]["mean"]) / m[c]["std"] for c in cols})
