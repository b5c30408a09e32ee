"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is run to completion into the ``noop`` sink, so that every column
is computed, after one untimed warm-up query.  The metric is the sum of per-query
wall seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "forecast_univariate", "predict_blocks", "forecast_lags", "forecast_lags_calendar",
    "forecast_two_family", "cross_validate", "cv_score", "forecast_all_series", "forecast_recursive",
    "lag_join", "shift_rows", "row_position", "gap_windows", "attributes", "drop_incomplete",
    "sequence_multi",
]


def _many_series_lags(spark, sf_dir):
    """The per-series ridge lag model on the user panel (150 / 1,500 series at sf0.01 / sf0.1)."""
    from hourglass.plans import lagmodels
    from hourglass.sources import fixtures as fx
    p = fx.panel_users(spark, sf_dir)
    model, stats = lagmodels.fit_lags(p, "lags", 48, 4, 26, l2=1.0)
    return lagmodels.predict_blocks(fx.test_panel(p), model, stats, "lags", 48, 4)


def _many_series_cv(spark, sf_dir):
    """Blocked CV of the univariate model over the user panel."""
    from hourglass.operators.joins import param_grid
    from hourglass.plans import univariate
    from hourglass.sources import fixtures as fx
    grid = param_grid(spark, {"kind": ["mean", "last"], "l2": [0.0, 1.0, 10.0]})
    return univariate.cross_validate_univariate(fx.panel_users(spark, sf_dir), grid, 24, 4, 5, k=4)[1]


def _many_series_lag_join(spark, sf_dir):
    """Exact lags 1 and 2 of the user panel."""
    from hourglass.operators import lags
    from hourglass.sources import fixtures as fx
    return lags.lag_features(fx.panel_users(spark, sf_dir), [1, 2])


def _many_series_shift(spark, sf_dir):
    """Positional shifts of the user panel."""
    from hourglass.operators import lags
    from hourglass.sources import fixtures as fx
    return lags.shift_rows(fx.panel_users(spark, sf_dir), [1, 2])


def _many_series_univariate(spark, sf_dir):
    """The flagship flow (windows, scaler, fit, error per series) on the user panel."""
    from hourglass.plans import forecast
    from hourglass.sources import fixtures as fx
    return forecast.univariate_scores(fx.panel_users(spark, sf_dir))


EXTRA = {"users_forecast_lags": _many_series_lags, "users_cross_validate": _many_series_cv,
         "users_lag_join": _many_series_lag_join, "users_shift_rows": _many_series_shift,
         "users_forecast_univariate": _many_series_univariate}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from hourglass.plans import catalog
    from hourglass.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app_name="hourglass-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up, not timed: one whole query, so no timed query pays for class loading and code generation.
    catalog.run("scaler_fit", spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    if not sys.argv[1:]:
        for name, fn in EXTRA.items():
            t0 = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
