"""Long/wide reshaping, null rules, projections on the long panel.

The long panel ``(series, ts, value)`` is the canonical form; the wide
form (``ts`` + one column per series) exists only at sources and sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.functions.numeric import clip_floor, is_finite, nan_to_null


def q(name: str) -> str:
    """Backtick-quote a column name (series names contain ``.``, ``+``, ``/``, ``-``, spaces)."""
    return "`" + name.replace("`", "``") + "`"


def series_of(wide: DataFrame, ts: str = "ts", exclude: Sequence[str] = ()) -> list[str]:
    """Series columns of a wide panel: every column except the timestamp (and ``exclude``), sorted."""
    skip = {ts, *exclude}
    return sorted(c for c in wide.columns if c not in skip)


def to_long(wide: DataFrame, ts: str = "ts", series: Sequence[str] | None = None) -> DataFrame:
    """Wide panel to long ``(series, ts, value)``; NaN becomes NULL."""
    names = list(series) if series is not None else series_of(wide, ts)
    w = wide.select(F.col(q(ts)).alias("ts"), *[F.col(q(n)).cast("double").alias(n) for n in names])
    return (w.unpivot("ts", [F.col(q(n)) for n in names], "series", "value")
            .select("series", "ts", nan_to_null("value").alias("value")))


def to_wide(long: DataFrame, names: Sequence[str] | None = None, value: str = "value",
            ts: str = "ts") -> DataFrame:
    """Long to wide: one row per ``ts``, one column per series (``names`` fixes order and width).

    Without ``names`` Spark runs one distinct pass to find the series; pass
    them when known.  ``first`` is exact because (series, ts) is unique.
    """
    g = long.groupBy(ts)
    p = g.pivot("series", list(names)) if names is not None else g.pivot("series")
    return p.agg(F.first(value))


def drop_incomplete(long: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Keep a timestamp only if EVERY series has a value there (wide ``dropna(how='any')``).

    The number of series is a scalar subquery; complete timestamps come
    from one partial-aggregated ``groupBy(ts)`` and are semi-joined back
    (AQE broadcasts them when small).
    """
    n_series = long.select(F.count_distinct("series")).scalar()
    complete = (long.groupBy(ts).agg(F.count(value).alias("_n"))
                .where(F.col("_n") == n_series).select(ts))
    return long.join(complete, ts, "left_semi")


def drop_incomplete_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``subset``."""
    return df.na.drop("any", subset=list(subset))


def finite_mask(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every column of ``cols`` is a finite number (no NULL, no NaN)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_finite(F.col(q(c)))
    return df.where(cond)


def missing_ts(long: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Timestamps where every series is NULL: the rows to be predicted."""
    return long.groupBy(ts).agg(F.count(value).alias("_n")).where(F.col("_n") == 0).select(ts)


def drop_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows before, after and dropped by ``drop_incomplete_subset`` on ``columns``, in one pass."""
    floating = {c for c, kind in rows.dtypes if kind in ("double", "float")}
    whole = F.lit(True)
    for c in columns:
        whole = whole & (is_finite(F.col(q(c))) if c in floating else F.col(q(c)).isNotNull())
    n, kept = F.count(F.lit(1)), F.count_if(whole)
    return rows.agg(n.alias("rows_before"), kept.alias("rows_after"), (n - kept).alias("rows_dropped"))


def filter_series(long: DataFrame, names: Sequence[str]) -> DataFrame:
    return long.where(F.col("series").isin(list(names)))


def align(df: DataFrame, cols: Sequence[str], fill=0) -> DataFrame:
    """Add missing columns as constant ``fill`` and select ``cols`` in that order."""
    have = set(df.columns)
    return df.select(*[F.col(q(c)) if c in have else F.lit(fill).alias(c) for c in cols])


def align_levels(long: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("ts",), fill: int = 0) -> DataFrame:
    """Long one-hot rows ``(keys, level, flag)`` to one column per name of ``cols``; names without a level get ``fill``."""
    return long.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("level") == F.lit(c), F.col("flag"))), F.lit(fill)).alias(c) for c in cols])


def mask_if(df: DataFrame, cond: Column, cols: Sequence[str]) -> DataFrame:
    """Set ``cols`` to NULL where ``cond`` holds (NULL ``cond`` masks too)."""
    return df.withColumns({c: F.when(F.coalesce(~cond, F.lit(False)), F.col(q(c))) for c in cols})


def clip(df: DataFrame, col: str, lo: float = 0.0) -> DataFrame:
    return df.withColumn(col, clip_floor(col, lo))


def sort_time(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in time order (then ``keys``): a range-partitioned global sort, used at sinks only."""
    return df.orderBy(F.col(ts), *[F.col(k) for k in keys])
