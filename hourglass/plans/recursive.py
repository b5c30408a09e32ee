"""Recursive multi-step fill of all-NULL rows.

Each round predicts the rows that are NULL in every series and have their
history present, writes the predictions back by key, and cuts the lineage
with a reliable checkpoint (shared ``spark.checkpoint.dir``), so round
``k`` never replays rounds ``1..k-1`` after an executor loss.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.operators.joins import fill_from
from hourglass.operators.lags import lag_features, shift_continuous
from hourglass.operators.panel import missing_ts
from hourglass.operators.position import number_rows
from hourglass.session import materialize


def lag1_linear_model(train: DataFrame) -> DataFrame:
    """Per-series ``value ~ value(t-1h)`` least squares: ``(series, slope, intercept)``."""
    lg = lag_features(train, [1])
    return lg.groupBy("series").agg(F.regr_slope("value", "value_lag1").alias("slope"),
                                    F.regr_intercept("value", "value_lag1").alias("intercept"))


def lag1_predictor(model: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def predict(cand: DataFrame) -> DataFrame:
        return cand.join(model, "series").select(
            "series", "ts", (F.col("intercept") + F.col("slope") * F.col("prev_1_value")).alias("prediction"))
    return predict


def recursive_fill(test: DataFrame, predictor: Callable[[DataFrame], DataFrame], steps: int = 4,
                   lags: Sequence[int] = (1,), strict: bool = False,
                   checkpoint: bool = True) -> DataFrame:
    """Predictions of ``steps`` rounds, stacked: ``(step, series, ts, prediction)``.

    ``predictor`` maps candidate rows ``(series, ts, value, prev_{n}_value...)``
    to ``(series, ts, prediction)``.  Candidates are rows whose timestamp is
    NULL in every series and whose previous values (positional shift with
    the continuity rule when ``strict=False``, exact time lags otherwise)
    are all present.
    """
    current = test.select("series", "ts", "value")
    out = None
    prev_cols = [f"prev_{n}_value" for n in lags]
    for step in range(1, steps + 1):
        feats = shift_continuous(current, list(lags), strict=strict)
        cand = feats.join(missing_ts(current), "ts", "left_semi")
        for c in prev_cols:
            cand = cand.where(F.col(c).isNotNull())
        pred = predictor(cand).withColumn("step", F.lit(step))
        nxt = fill_from(current, pred.withColumn("_new", F.lit(True)))
        if checkpoint:
            # One reliable checkpoint per round; the round's predictions are
            # read back from it, so no round replays the earlier ones.
            nxt = materialize(nxt)
        part = nxt.where(F.col("_new")).select(F.lit(step).alias("step"), "series", "ts",
                                               F.col("value").alias("prediction"))
        out = part if out is None else out.unionByName(part)
        current = nxt.drop("_new")
    return out


FILL_SQL = """
WITH RECURSIVE filled (step, series, ts, prediction) AS (
  SELECT 1, t.series, t.ts, m.intercept + m.slope * k.value
  FROM {todo} t JOIN {known} k ON k.series = t.series AND k.ts = t.ts - INTERVAL 1 HOUR JOIN {model} m ON m.series = t.series
  WHERE t.depth = 1 AND k.value IS NOT NULL
  UNION ALL
  SELECT f.step + 1, t.series, t.ts, m.intercept + m.slope * f.prediction
  FROM filled f JOIN {todo} t ON t.series = f.series AND t.ts = f.ts + INTERVAL 1 HOUR JOIN {model} m ON m.series = t.series
  WHERE f.step < {steps} AND t.depth = f.step + 1)
SELECT step, series, ts, prediction FROM filled WHERE prediction IS NOT NULL"""


def missing_depth(test: DataFrame) -> DataFrame:
    """``(ts, depth)`` of the hours that are NULL in every series: how many such hours in a row end there.

    Hours are grouped into runs by their distance to their own rank, which
    ``number_rows`` finds without a window over the whole axis.
    """
    hours = number_rows(missing_ts(test).select("ts"), "ts", out="_at")
    hours = hours.withColumn("_run", F.unix_seconds("ts") - F.col("_at") * 3600)
    starts = hours.groupBy("_run").agg(F.min("_at").alias("_first"))
    return hours.join(starts, "_run").select("ts", (F.col("_at") - F.col("_first") + 1).alias("depth"))


def recursive_fill_lag1(test: DataFrame, model: DataFrame, steps: int = 4) -> DataFrame:
    """``recursive_fill`` of a linear model on the previous hour, as one recursive query.

    Only the frontier moves: the hours predicted in a step are joined with the
    hours after them.  The panel is not rewritten and nothing is written
    between the steps.  ``test`` has a row for every hour of a block, as the
    canonical panel does, and ``model`` is ``(series, slope, intercept)``.
    """
    spark = test.sparkSession
    depth = missing_depth(test)
    todo = test.join(depth, "ts").where(F.col("depth") <= steps).select("series", "ts", "depth")
    # Only the hours right before a run are needed of the known values.
    before = depth.where("depth = 1").select((F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    known = test.join(before, "ts", "left_semi").select("series", "ts", "value")
    return spark.sql(FILL_SQL.format(todo="{todo}", known="{known}", model="{model}", steps=int(steps)), todo=todo, known=known, model=model)
