"""Column-level functions (JVM-side expressions)."""

from hourglass.functions.calendar import (  # noqa: F401
    ATTRIBUTE_NAMES, attribute_columns, attributes, date_parts, day_of_week,
    easter_date, easter_holiday, fixed_holiday, format_ts, is_weekend, month_day, one_hot,
    one_hot_columns, parse_ts, school_holiday,
)
from hourglass.functions.numeric import as_float, clip_floor, is_finite, nan_to_null  # noqa: F401
