"""Lags by exact time offset and by row, time deltas, continuity masks.

Lags by time cut the time axis into stretches: a row goes to its own stretch
and, near its end, also to the next one, and a window per (series, stretch)
finds its partners.  Lags by row explode each row into itself and its shifted
copies and aggregate by ``(series, row)``.  Either is one shuffle on a key
that a series with a third of all rows has many of, so it is spread over every
task, which a window partitioned by series would not do.  ``(series, ts)``
must be unique, as in the canonical panel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.operators.position import DEFAULT_CHUNK_SECONDS, number_rows

STRETCH_REACHES = 24  # a stretch is this many times the longest lag: that share of the rows is held twice


def gather_shifted(df: DataFrame, keys: Sequence[str], key: str, carried: Mapping[str, Mapping[int, str]],
                   shift: Callable[[Column, int], Column]) -> DataFrame:
    """For every row, values of the rows whose ``key`` is ``shift(key, n)`` earlier.

    ``carried`` maps a column to ``{n: output name}``.  Row ``r`` is emitted
    once as itself and once per lag at key ``shift(r.key, n)`` (one generator
    over one scan of ``df``); one ``groupBy(keys, key)`` then gathers, for each
    key, the original row and the values shifted onto it.  Keys with no
    original row are dropped; missing partners give NULL.  Two original rows
    with one key raise an error when the plan runs: one of them would vanish.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in (*keys, key)]
    lags = sorted({n for names in carried.values() for n in names})
    places = [F.struct(F.lit(0).alias("k"), F.col(key).alias("at"))]
    places += [F.struct(F.lit(n).alias("k"), shift(F.col(key), n).alias("at")) for n in lags]
    k = F.col("_copy.k")
    rows = df.withColumn("_copy", F.explode(F.array(*places))).select(
        *keys, F.col("_copy.at").alias(key), k.alias("_k"),
        *[F.when(k == 0, F.col(c)).alias(c) for c in others],
        *[F.when(k > 0, F.col(c)).alias(f"_from_{c}") for c in carried])
    aggs = [F.sum((F.col("_k") == 0).cast("int")).alias("_present")]
    # Only the original row (k = 0) has non-NULL ``others``; ``first`` with
    # ignorenulls is then exact and deterministic.
    aggs += [F.first(F.col(c), ignorenulls=True).alias(c) for c in others]
    aggs += [F.max(F.when(F.col("_k") == n, F.col(f"_from_{c}"))).alias(name)
             for c, names in carried.items() for n, name in names.items()]
    twice = F.raise_error(F.lit(f"more than one row with the same {', '.join([*keys, key])}")).cast("boolean")
    once = F.when(F.col("_present") > 1, twice).otherwise(F.col("_present") == 1)
    return rows.groupBy(*keys, key).agg(*aggs).where(once).drop("_present")


def lag_features(long: DataFrame, lags: Sequence[int] = (1, 2), unit_seconds: int = 3600,
                 value: str = "value", ts: str = "ts", keys: Sequence[str] = ("series",),
                 suffix: str = "_lag{n}") -> DataFrame:
    """Value at exactly ``ts - n * unit`` for every ``n`` in ``lags``; NULL where that time is absent.

    Same result as a left self-join on the shifted timestamp, without the
    join: a window per (keys, stretch of time), whose rows are few whatever
    the skew.  Output columns are ``value`` + ``suffix`` (``value_lag1``, ...).
    """
    names = {n: f"{value}{suffix.format(n=n)}" for n in lags}
    if not names or min(names) < 1 or unit_seconds < 1:
        return gather_shifted(long, keys, ts, {value: names}, lambda c, n: c + F.make_dt_interval(secs=F.lit(n * unit_seconds)))
    keys = list(keys)
    others = [c for c in long.columns if c not in (*keys, ts)]
    unit = unit_seconds * 1_000_000
    reach = max(names) * unit
    stretch = lambda us: F.floor(us / F.lit(STRETCH_REACHES * reach))

    def place(us: Column, halo: bool) -> Column:
        return F.struct(stretch(us).alias("stretch"), F.lit(halo).alias("halo"))

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    crosses = stretch(us + F.lit(reach)) > stretch(us)
    places = F.when(crosses, F.array(place(us, False), place(us + F.lit(reach), True))).otherwise(F.array(place(us, False)))
    held = long.select(*keys, ts, *others, us.alias("_us"), F.explode(places).alias("_held"))
    held = held.select(*keys, ts, *others, "_us", F.col("_held.stretch").alias("_stretch"), F.col("_held.halo").alias("_halo"))
    at = Window.partitionBy(*keys, "_stretch").orderBy("_us")
    before = F.lag(F.struct("_us")).over(at)  # null on the first row only
    found = held.withColumns({"_same": before.isNotNull() & before["_us"].eqNullSafe(F.col("_us")),
                              **{name: F.max(value).over(at.rangeBetween(-n * unit, -n * unit)) for n, name in names.items()}})
    twice = F.raise_error(F.lit(f"more than one row with the same {', '.join([*keys, ts])}")).cast("boolean")
    return found.where(F.when(F.col("_same"), twice).otherwise(~F.col("_halo"))).select(*keys, ts, *others, *names.values())


def shift_rows(long: DataFrame, lags: Sequence[int] = (1,), value: str = "value", ts: str = "ts",
               keys: Sequence[str] = ("series",), prefix: str = "prev_{n}_",
               chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS, with_prev_ts: bool = False) -> DataFrame:
    """Value ``n`` ROWS earlier within each series (positional; holes in time are ignored).

    Rows are numbered per series without a per-series window (see
    ``number_rows``), then shifted copies are gathered on ``(series, row)``.
    ``with_prev_ts`` also returns the previous row's timestamp as ``prev_ts``.
    """
    lags = sorted(set(lags) | ({1} if with_prev_ts else set()))
    numbered = number_rows(long, ts=ts, keys=keys, out="_row", chunk_seconds=chunk_seconds)
    carried = {value: {n: prefix.format(n=n) + value for n in lags}}
    if with_prev_ts:
        carried[ts] = {1: "prev_ts"}
    return gather_shifted(numbered, keys, "_row", carried, lambda c, n: c + F.lit(n)).drop("_row")


def delta_hours(df: DataFrame, ts: str = "ts", prev_ts: str = "prev_ts") -> DataFrame:
    """Hours since the previous row of the series (NULL on the first row)."""
    return df.withColumn("delta_hours",
                         (F.unix_seconds(F.col(ts)) - F.unix_seconds(F.col(prev_ts))) / F.lit(3600.0))


def shift_continuous(long: DataFrame, lags: Sequence[int] = (1, 2), value: str = "value",
                     ts: str = "ts", keys: Sequence[str] = ("series",), strict: bool = True,
                     unit_seconds: int = 3600) -> DataFrame:
    """Previous values that are continuous in time, as ``prev_{n}_<value>`` columns.

    ``strict=True`` (default) is the exact time lag.  ``strict=False`` is the
    positional shift, NULLed unless the CURRENT row is exactly one unit after
    the previous row; a hole between t-2 and t-1 still passes (the
    reference's test-time rule).
    """
    names = {n: f"prev_{n}_{value}" for n in lags}
    if strict:
        return lag_features(long, lags, unit_seconds, value, ts, keys, suffix="_lag{n}") \
            .withColumnsRenamed({f"{value}_lag{n}": nm for n, nm in names.items()})
    s = delta_hours(shift_rows(long, lags, value, ts, keys, with_prev_ts=True), ts=ts)
    ok = F.coalesce(F.col("delta_hours") == F.lit(unit_seconds / 3600.0), F.lit(False))
    out = s.withColumns({nm: F.when(ok, F.col(nm)) for nm in names.values()})
    extra = [f"prev_1_{value}"] if 1 not in lags else []
    return out.drop("prev_ts", "delta_hours", *extra)
