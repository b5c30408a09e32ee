"""End-to-end forecasting flows composed from the operators.

Each function returns the final DataFrame; the windows and the sequences are
written to the shared folder while the plan is built, the rest runs with the
caller's action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.operators.metrics import mse
from hourglass.operators.panel import drop_incomplete
from hourglass.operators.scale import apply_scaler, fit_scaler
from hourglass.operators.sequences import sequences
from hourglass.operators.windows import gap_windows
from hourglass.plans.univariate import fit_univariate, predict_univariate
from hourglass.session import materialize


def windowed(panel: DataFrame, train: int = 48, predict: int = 4, gap: int = 26,
             complete_only: bool = True) -> DataFrame:
    """Panel -> complete timestamps -> gap windows -> train-statistics scaling.

    The scaler is fit on the input (``x``) rows only; targets stay in
    their unit (the reference fits scaled inputs against raw targets).
    """
    p = drop_incomplete(panel) if complete_only else panel
    w = materialize(gap_windows(p, train, predict, gap))
    stats = fit_scaler(w, where=F.col("role") == "x")
    return apply_scaler(w, stats)


def univariate_scores(panel: DataFrame, train: int = 48, predict: int = 4, gap: int = 26,
                      kind: str = "mean") -> DataFrame:
    """Minimum slice: windows -> scaler -> sequences -> per-horizon fit -> MSE per series.

    Fit and scored on the same windows (an in-sample error, as a
    regression anchor, not a forecast quality claim).
    """
    seq = materialize(sequences(windowed(panel, train, predict, gap), train=train, predict=predict), "sequences")
    model = fit_univariate(seq, kind=kind)
    pred = predict_univariate(seq, model, kind=kind)
    return mse(pred, ["series"])


def stack_predictions(parts: dict[str, DataFrame], cols=("series", "ts", "prediction")) -> DataFrame:
    """Predictions of several models or rounds stacked with a ``model`` label (``unionByName``)."""
    out = None
    for name, df in parts.items():
        d = df.select(F.lit(name).alias("model"), *cols)
        out = d if out is None else out.unionByName(d)
    return out
