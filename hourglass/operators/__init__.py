"""DataFrame -> DataFrame operators on long panels."""

from hourglass.operators.joins import (  # noqa: F401
    fill_from, param_grid, semi_timestamps, unmatched, with_attributes, with_grid,
)
from hourglass.operators.lags import delta_hours, lag_features, shift_continuous, shift_rows  # noqa: F401
from hourglass.operators.metrics import best_config, cv_score, mse, sort_scores  # noqa: F401
from hourglass.operators.panel import (  # noqa: F401
    align, clip, drop_incomplete, drop_incomplete_subset, drop_report, filter_series, finite_mask, sort_time,
    mask_if, missing_ts, series_of, to_long, to_wide,
)
from hourglass.operators.position import number_rows, positions, with_pos  # noqa: F401
from hourglass.operators.scale import (  # noqa: F401
    apply_scaler, apply_scaler_matrix, fit_scaler, fit_scaler_matrix, invert_scaler,
)
from hourglass.operators.sequences import concat_families, explode_horizon, flatten_attrs  # noqa: F401
from hourglass.operators.windows import (  # noqa: F401
    blocked_folds, gap_windows, hashed_folds, split_rows, split_windows, target_timestamps, test_blocks,
)
