"""Fixed-length samples from windowed long rows.

One ``groupBy(keys, window_id)`` per call: each group holds exactly one
window (``train + predict`` rows), so groups are bounded by the window
length whatever the skew between series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.operators.panel import q


def _ordered(values: Column, role: str, offset: str = "offset") -> Column:
    """Values of the rows with ``role``, ordered by ``offset``, as an array."""
    pairs = F.array_sort(F.collect_list(
        F.when(F.col("role") == F.lit(role), F.struct(F.col(offset).alias("o"), values.alias("v")))))
    return F.transform(pairs, lambda s: s["v"])


def sequences(w: DataFrame, x_col: str = "scaled", y_col: str = "value",
              keys: Sequence[str] = ("series",), window: str = "window_id",
              attrs: Sequence[str] | None = None, families: bool = False,
              train: int | None = None, predict: int | None = None,
              target_ts: str | None = None, input_ts: str | None = None) -> DataFrame:
    """One row per ``(keys, window)``: ``x`` (inputs) and ``y`` (targets) arrays.

    * plain: ``x ARRAY<DOUBLE>`` of the input values.
    * ``attrs`` given: ``x ARRAY<ARRAY<DOUBLE>>``, per hour ``[value, attr...]``.
    * ``attrs`` and ``families``: ``x`` values and ``x_attrs ARRAY<ARRAY<DOUBLE>>``
      side by side (the two-family layout).
    ``train``/``predict`` drop partial windows (``size(x) = train`` and ``size(y) = predict``).
    ``target_ts`` names a timestamp column whose target-row values are kept as the array ``y_ts``,
    ``input_ts`` one whose input-row values are kept as ``x_ts``.
    """
    v = F.col(x_col).cast("double")
    aggs = []
    if attrs and not families:
        aggs.append(_ordered(F.array(v, *[F.col(q(a)).cast("double") for a in attrs]), "x").alias("x"))
    else:
        aggs.append(_ordered(v, "x").alias("x"))
        if attrs:
            aggs.append(_ordered(F.array(*[F.col(q(a)).cast("double") for a in attrs]), "x")
                        .alias("x_attrs"))
    aggs.append(_ordered(F.col(y_col).cast("double"), "y").alias("y"))
    if target_ts:
        aggs.append(_ordered(F.col(target_ts), "y").alias("y_ts"))
    if input_ts:
        aggs.append(_ordered(F.col(input_ts), "x").alias("x_ts"))
    out = w.groupBy(*keys, window).agg(*aggs)
    if train is not None:
        out = out.where(F.size("x") == train)
    if predict is not None:
        out = out.where(F.size("y") == predict)
    return out


def flatten_attrs(seq: DataFrame, col: str = "x_attrs", out: str = "x_attrs_flat") -> DataFrame:
    """Hour-by-attribute matrix flattened to one vector (48 x 45 = 2160 values)."""
    return seq.withColumn(out, F.flatten(F.col(col)))


def concat_families(seq: DataFrame, out: str = "x_all") -> DataFrame:
    """Value branch and flattened attribute branch concatenated into one input vector."""
    return seq.withColumn(out, F.concat(F.col("x"), F.flatten(F.col("x_attrs"))))


def explode_horizon(pred: DataFrame, col: str = "prediction", keys: Sequence[str] = ("series",),
                    window: str = "window_id") -> DataFrame:
    """A per-window prediction vector back to one row per horizon: ``(keys, window, horizon, prediction)``."""
    return pred.select(*keys, window, F.posexplode(col).alias("horizon", "prediction"))
