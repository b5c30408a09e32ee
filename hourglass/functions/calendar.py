"""Calendar columns: timestamp parsing/formatting, date parts, holidays, one-hots.

Everything here is a Column expression (JVM side, whole-stage codegen); none
of it shuffles.  Calendar parts are taken in the session time zone, which
``hourglass.session`` pins to UTC.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Fixed-date holidays, as month-day strings.
FIXED_HOLIDAYS = (
    "01-01", "01-02", "02-08", "04-27", "05-01", "05-02",
    "06-25", "08-15", "10-31", "11-01", "12-25", "12-26",
)
# Easter-related holidays, as day offsets from Easter Sunday:
# Easter Sunday, Easter Monday, Pentecost Sunday.
EASTER_OFFSETS = (0, 1, 49)
# School holidays, as inclusive month-day ranges.
SCHOOL_HOLIDAY_RANGES = (
    ("06-25", "08-31"),
    ("12-25", "12-31"),
    ("01-01", "01-02"),
)
# Weekend days in the Monday = 0 numbering.
WEEKEND_DAYS = (5, 6)
# Timestamp text format of the panels: yyyy-MM-ddTHH:mmZ, UTC.
TS_PARSE_FORMAT = "yyyy-MM-dd'T'HH:mmX"
TS_WRITE_FORMAT = "yyyy-MM-dd'T'HH:mm'Z'"
# ---------------------------------------------------------------------------

HOUR_DOMAIN = tuple(range(24))
MONTH_DOMAIN = tuple(range(1, 13))
WEEKDAY_DOMAIN = tuple(range(7))


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: str | Column) -> Column:
    """``2022-08-01T05:00Z`` text to a UTC timestamp (a plain cast throws under ANSI)."""
    return F.to_timestamp(_c(c), TS_PARSE_FORMAT)


def format_ts(c: str | Column) -> Column:
    """Timestamp back to the panel text format ``yyyy-MM-ddTHH:mmZ``."""
    return F.date_format(_c(c), TS_WRITE_FORMAT)


def month_day(c: str | Column) -> Column:
    return F.date_format(_c(c), "MM-dd")


def day_of_week(c: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(c))


def date_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour, month, day_of_week (Mon=0), month_day, date and year."""
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t),
        "month": F.month(t),
        "day_of_week": day_of_week(t),
        "month_day": month_day(t),
        "date": F.to_date(t),
        "year": F.year(t),
    })


def is_weekend(c: str | Column) -> Column:
    return day_of_week(c).isin(*WEEKEND_DAYS).cast("int")


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def easter_date(year: str | Column) -> Column:
    """Easter Sunday (Gregorian) of a year column, as pure column arithmetic.

    Anonymous Gregorian computus; agrees with the usual library function for
    every year from 1583 on.  No per-row Python, no distinct-years pass.
    """
    y = _c(year).cast("long")
    a = y % 19
    b = _idiv(y, 100)
    c = y % 100
    d = _idiv(b, 4)
    e = b % 4
    f = _idiv(b + 8, 25)
    g = _idiv(b - f + 1, 3)
    h = (a * 19 + b - d - g + 15) % 30
    i = _idiv(c, 4)
    k = c % 4
    l_ = F.pmod(F.lit(32) + e * 2 + i * 2 - h - k, F.lit(7))
    m = _idiv(a + h * 11 + l_ * 22, 451)
    s = h + l_ - m * 7 + 114
    return F.make_date(y.cast("int"), _idiv(s, 31).cast("int"), (s % 31 + 1).cast("int"))


def fixed_holiday(ts: str | Column, fixed: Iterable[str] = FIXED_HOLIDAYS) -> Column:
    return month_day(ts).isin(*list(fixed))


def easter_holiday(ts: str | Column, offsets: Iterable[int] = EASTER_OFFSETS) -> Column:
    d = F.to_date(_c(ts))
    return F.datediff(d, easter_date(F.year(d))).isin(*list(offsets))


def school_holiday(ts: str | Column, ranges=SCHOOL_HOLIDAY_RANGES) -> Column:
    md = month_day(ts)
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | md.between(lo, hi)
    return cond


def calendar(df: DataFrame, ts: str = "ts", fixed: Iterable[str] = FIXED_HOLIDAYS,
             offsets: Iterable[int] = EASTER_OFFSETS) -> DataFrame:
    """Add ``is_weekend``, ``is_holiday`` and ``is_school_holiday`` (BYTE) to any DataFrame with a timestamp.

    One projection, no shuffle; original columns are kept.
    """
    hol = fixed_holiday(ts, fixed) | easter_holiday(ts, offsets)
    return df.withColumns({
        "is_weekend": is_weekend(ts).cast("byte"),
        "is_holiday": hol.cast("byte"),
        "is_school_holiday": school_holiday(ts).cast("byte"),
    })


def one_hot_columns(c: str | Column, domain: Sequence, prefix: str) -> list[Column]:
    """``prefix_v`` = 1 where ``c == v`` for every ``v`` of a FIXED domain (absent levels 0)."""
    col = _c(c)
    return [F.coalesce((col == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in domain]


def one_hot(df: DataFrame, c: str, domain: Sequence, prefix: str | None = None, drop: bool = False) -> DataFrame:
    """One-hot a column over a fixed domain, one column per level."""
    out = df.select("*", *one_hot_columns(c, domain, prefix or c))
    return out.drop(c) if drop else out


def one_hot_observed(df: DataFrame, c: str, prefix: str | None = None) -> DataFrame:
    """One-hot a column over the levels that occur in it, as long rows ``(..., level, flag)``.

    Every row comes once per level, ``level`` being ``prefix_value``; a null
    value has flag 0 everywhere.  The sorted levels enter as a scalar
    subquery, so their number is not limited by a column count and nothing
    is collected.
    """
    levels = df.select(F.array_sort(F.collect_set(c))).scalar()
    name = F.concat(F.lit(f"{prefix or c}_"), F.col("_level").cast("string"))
    flag = F.coalesce((_c(c) == F.col("_level")).cast("int"), F.lit(0))
    return (df.select("*", F.explode(levels).alias("_level"))
            .withColumns({"level": name, "flag": flag}).drop("_level", c))


ATTRIBUTE_NAMES = (
    ["is_holiday", "is_school_holiday"]
    + [f"hour_{h}" for h in HOUR_DOMAIN]
    + [f"month_{m}" for m in MONTH_DOMAIN]
    + [f"day_of_week_{d}" for d in WEEKDAY_DOMAIN]
)


def attribute_columns(ts: str | Column = "ts") -> list[Column]:
    """The 45 per-timestamp attributes as columns: 2 flags + 24 + 12 + 7 one-hots."""
    t = _c(ts)
    hol = (fixed_holiday(t) | easter_holiday(t)).cast("int").alias("is_holiday")
    sch = school_holiday(t).cast("int").alias("is_school_holiday")
    return ([hol, sch]
            + one_hot_columns(F.hour(t), HOUR_DOMAIN, "hour")
            + one_hot_columns(F.month(t), MONTH_DOMAIN, "month")
            + one_hot_columns(day_of_week(t), WEEKDAY_DOMAIN, "day_of_week"))


def attributes(panel: DataFrame, ts: str = "ts") -> DataFrame:
    """Per-timestamp attribute table (``ts`` + 45 INT attributes).

    One row per distinct timestamp of the panel: a partial-aggregated
    distinct (map-side combine, so a hot series does not matter), then a
    single projection.
    """
    return panel.select(ts).distinct().select(ts, *attribute_columns(ts))
