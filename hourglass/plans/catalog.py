"""Registered queries: one per operator of the inventory, each with its SQL twin.

Every query reads the driver's tables through the fixture panels of
``hourglass.sources.fixtures`` and runs the operator named by its key over
the whole table.  ``queries()`` / ``oracle_sql()`` in ``__spark_entry__``
are built from ``REGISTRY``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hourglass.functions.calendar as cal
from hourglass.functions.numeric import as_float, clip_floor
from hourglass.operators import joins, lags, metrics, panel, position, scale, sequences, windows
from hourglass.plans import forecast, lagmodels, sqlparts as S, univariate
from hourglass.plans.present import present, wrap_sql
from hourglass.session import materialize, scratch_dir
from hourglass.sources import fixtures as fx
from hourglass.sources import layout
from hourglass.sources import panels as io
from hourglass.streaming import start_featurizer


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(fn, spec, sql)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    qd = REGISTRY[name]
    return present(qd.fn(spark, sf_dir), qd.spec)


def oracle(name: str) -> str | None:
    qd = REGISTRY[name]
    return None if qd.sql is None else wrap_sql(qd.sql, qd.spec)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared folder, for queries that write and read back."""
    return scratch_dir(spark, tag)


LONG = "series:s ts:t value:d"
TRAIN, PREDICT, GAP = 48, 4, 26          # flagship window triple
S_TRAIN, S_PREDICT, S_GAP = 24, 4, 5     # short triple (FIXTURES.md)
FOLDS = 5

# The event types, which are the series of the hourly panel.
SERIES = ("click", "error", "purchase", "signup", "view")

# ---------------------------------------------------------------- 2.1 sources / sinks


@query("scan_panel_csv", LONG, S.with_(S.hourly()) + "SELECT series, ts, value FROM panel")
def q_scan_panel_csv(spark, sf):
    path = scratch_path(spark, "panel")
    io.write_panel(fx.panel_hourly(spark, sf), path, SERIES)
    return io.read_panel(spark, path)


@query("scan_test_csv", LONG,
       S.with_(S.hourly(), S.test_panel()) + "SELECT series, ts, value FROM testp")
def q_scan_test_csv(spark, sf):
    path = scratch_path(spark, "test")
    io.write_panel(fx.test_panel(fx.panel_hourly(spark, sf)), path, SERIES)
    return io.read_test_panel(spark, path)


@query("scan_panel_files", LONG, S.with_(S.hourly()) + "SELECT * FROM panel WHERE series IN ('click', 'error', 'purchase') AND day(ts) <= 15 UNION ALL "
       + "SELECT * FROM panel WHERE series IN ('view', 'purchase', 'signup') AND day(ts) > 15")
def q_scan_panel_files(spark, sf):
    # Two wide files in one folder with other columns in another order.
    p, path = fx.panel_hourly(spark, sf), scratch_path(spark, "files")
    early = F.dayofmonth("ts") <= 15
    io.write_panel(p.where(early), path, ["click", "error", "purchase"])
    io.write_panel(p.where(~early), path, ["view", "purchase", "signup"], mode="append")
    return io.read_panel(spark, path)


@query("sink_panel_groups", LONG, S.with_(S.hourly(series="user_id")) + "SELECT * FROM panel")
def q_sink_panel_groups(spark, sf):
    # Every user is a series: more columns than one file takes, in groups.
    path = scratch_path(spark, "groups")
    io.write_panel_groups(fx.panel_users(spark, sf), path)
    return io.read_panel_groups(spark, path)


@query("scan_stations", "name:s latitude:d longitude:d",
       "SELECT s_name AS name, s_acctbal AS latitude, CAST(s_nationkey AS DOUBLE) AS longitude FROM supplier")
def q_scan_stations(spark, sf):
    # Stand-in station file in the (name, latitude, longitude) schema, from `supplier`.
    path = scratch_path(spark, "stations")
    (spark.read.parquet(f"{sf}/supplier.parquet")
     .select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("latitude"),
             F.col("s_nationkey").cast("double").alias("longitude"))
     .write.mode("overwrite").option("header", True).csv(path))
    return io.read_stations(spark, path)


# ---------------------------------------------------------------- 2.2 projections / filters


@query("drop_incomplete", LONG,
       S.with_(S.sparse(), S.drop_incomplete("di", "sparse")) + "SELECT series, ts, value FROM di")
def q_drop_incomplete(spark, sf):
    return panel.drop_incomplete(fx.panel_hourly_sparse(spark, sf))


LAGGED_SQL = """lagged AS (
  SELECT s.series, s.ts, s.value, l1.value AS value_lag1, l2.value AS value_lag2
  FROM sparse s
  LEFT JOIN sparse l1 ON l1.series = s.series AND l1.ts + INTERVAL 1 HOUR = s.ts
  LEFT JOIN sparse l2 ON l2.series = s.series AND l2.ts + INTERVAL 2 HOUR = s.ts)"""
LAGGED_SPEC = LONG + " value_lag1:d value_lag2:d"


def _lagged(spark, sf):
    return lags.lag_features(fx.panel_hourly_sparse(spark, sf), [1, 2])


@query("lag_join", LAGGED_SPEC, S.with_(S.sparse(), LAGGED_SQL) + "SELECT * FROM lagged")
def q_lag_join(spark, sf):
    return _lagged(spark, sf)


@query("lag_join_stored", LAGGED_SPEC, S.with_(S.sparse(), LAGGED_SQL) + "SELECT * FROM lagged")
def q_lag_join_stored(spark, sf):
    # The same lags from the bucketed layout, opened by its path.
    path = scratch_path(spark, "layout")
    layout.write_stored_panel(fx.panel_hourly_sparse(spark, sf), path, stretch_rows=168)
    return layout.stored_lags(layout.open_stored_panel(spark, path), [1, 2])


@query("drop_incomplete_subset", LAGGED_SPEC,
       S.with_(S.sparse(), LAGGED_SQL)
       + "SELECT * FROM lagged WHERE value_lag1 IS NOT NULL AND value_lag2 IS NOT NULL")
def q_drop_incomplete_subset(spark, sf):
    return panel.drop_incomplete_subset(_lagged(spark, sf), ["value_lag1", "value_lag2"])


@query("dropped_count", "rows_before:i rows_after:i rows_dropped:i",
       S.with_(S.sparse(), LAGGED_SQL)
       + """SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE value_lag1 IS NOT NULL AND value_lag2 IS NOT NULL) AS rows_after,
       count(*) FILTER (WHERE value_lag1 IS NULL OR value_lag2 IS NULL) AS rows_dropped FROM lagged""")
def q_dropped_count(spark, sf):
    before = _lagged(spark, sf)
    return panel.drop_report(before, ["value_lag1", "value_lag2"])


@query("finite_mask", LAGGED_SPEC + " ratio:d",
       S.with_(S.sparse(), LAGGED_SQL)
       + """SELECT * FROM (SELECT *, CASE WHEN value_lag1 = 0 AND value = 0 THEN CAST('NaN' AS DOUBLE)
                  WHEN value_lag1 = 0 THEN NULL ELSE value / value_lag1 END AS ratio FROM lagged) t
WHERE value_lag1 IS NOT NULL AND NOT isnan(value_lag1) AND ratio IS NOT NULL AND NOT isnan(ratio)""")
def q_finite_mask(spark, sf):
    # ratio is NaN for 0/0 and NULL for x/0: both must be dropped.
    lg = _lagged(spark, sf)
    ratio = (F.when((F.col("value_lag1") == 0) & (F.col("value") == 0), F.lit(float("nan")))
             .when(F.col("value_lag1") == 0, F.lit(None).cast("double"))
             .otherwise(F.col("value") / F.col("value_lag1")))
    return panel.finite_mask(lg.withColumn("ratio", ratio), ["value_lag1", "ratio"])


@query("all_null_rows", "ts:t",
       S.with_(S.hourly(), S.test_panel()) + "SELECT ts FROM testp GROUP BY ts HAVING count(value) = 0")
def q_all_null_rows(spark, sf):
    return panel.missing_ts(fx.test_panel(fx.panel_hourly(spark, sf)))


@query("series_columns", "series:s", S.with_(S.hourly()) + "SELECT DISTINCT series FROM panel")
def q_series_columns(spark, sf):
    # The series that the headers of wide files written from the panel name.
    path = scratch_path(spark, "wide")
    io.write_panel(fx.panel_hourly(spark, sf), path, SERIES)
    return io.panel_series(spark, path)


SELECTED = ("click", "purchase", "view")


@query("select_series", LONG, S.with_(S.hourly())
       + "SELECT * FROM panel WHERE series IN ('click', 'purchase', 'view')")
def q_select_series(spark, sf):
    return panel.filter_series(fx.panel_hourly(spark, sf), SELECTED)


@query("project_attributes", "ts:t is_holiday:i is_school_holiday:i",
       S.with_(S.daily()) + f"""SELECT ts, CAST({S.is_holiday('ts')} AS INTEGER) AS is_holiday,
       CAST({S.is_school_holiday('ts')} AS INTEGER) AS is_school_holiday FROM (SELECT DISTINCT ts FROM daily) d""")
def q_project_attributes(spark, sf):
    days = fx.panel_daily(spark, sf).select("ts").distinct()
    return cal.calendar(days, "ts").select("ts", "is_holiday", "is_school_holiday")


HOURS_SPEC = "ts:t " + " ".join(f"hour_{h}:i" for h in cal.HOUR_DOMAIN)


@query("align_columns", HOURS_SPEC,
       S.with_(S.sparse()) + "SELECT ts, " + ", ".join(
           f"CAST(hour(ts) = {h} AND hour(ts) IN (SELECT DISTINCT hour(ts) FROM sparse) "
           f"AS INTEGER) AS hour_{h}" for h in cal.HOUR_DOMAIN)
       + " FROM (SELECT DISTINCT ts FROM sparse) t")
def q_align_columns(spark, sf):
    # Observed hour levels, then aligned to the full 24-hour domain.
    d = fx.panel_hourly_sparse(spark, sf).select("ts").distinct()
    levels = cal.one_hot_observed(d.withColumn("hour", F.hour("ts")), "hour")
    return panel.align_levels(levels, [f"hour_{h}" for h in cal.HOUR_DOMAIN])


@query("mask_if", LONG, S.with_(S.hourly())
       + "SELECT series, ts, CASE WHEN hour(ts) < 6 THEN NULL ELSE value END AS value FROM panel")
def q_mask_if(spark, sf):
    p = fx.panel_hourly(spark, sf)
    return panel.mask_if(p, F.hour("ts") < 6, ["value"])


@query("clip_floor", LONG + " residual:d", S.with_(S.sparse(), LAGGED_SQL)
       + """SELECT series, ts, value, CASE WHEN value_lag1 IS NULL THEN NULL
       ELSE greatest(value - value_lag1, 0) END AS residual FROM lagged""")
def q_clip_floor(spark, sf):
    lg = _lagged(spark, sf)
    return lg.select("series", "ts", "value", clip_floor(F.col("value") - F.col("value_lag1")).alias("residual"))


@query("cast_features", "ts:t is_holiday:i hour_7:i value:d value_f:d",
       S.with_(S.hourly()) + f"""SELECT ts, CAST(CAST({S.is_holiday('ts')} AS TINYINT) AS INTEGER) AS is_holiday,
       CAST(hour(ts) = 7 AS INTEGER) AS hour_7, value, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value_f
FROM panel""")
def q_cast_features(spark, sf):
    p = fx.panel_hourly(spark, sf)
    c = cal.calendar(p)
    return c.select("ts", F.col("is_holiday").cast("byte").alias("is_holiday"),
                    (F.hour("ts") == 7).cast("int").alias("hour_7"), "value",
                    as_float("value").alias("value_f"))


@query("wide_to_long", LONG, S.with_(S.hourly()) + "SELECT series, ts, value FROM panel")
def q_wide_to_long(spark, sf):
    return panel.to_long(panel.to_wide(fx.panel_hourly(spark, sf), SERIES))


@query("long_to_wide", "ts:t " + " ".join(f"{n}:d" for n in SERIES), S.with_(S.hourly()) + "SELECT ts, "
       + ", ".join(f"max(CASE WHEN series = '{n}' THEN value END) AS {n}" for n in SERIES) + " FROM panel GROUP BY ts")
def q_long_to_wide(spark, sf):
    return panel.to_wide(fx.panel_hourly(spark, sf), SERIES)


# ---------------------------------------------------------------- 2.3 calendar


DAYS = "days AS (SELECT DISTINCT ts FROM daily)"


@query("ts_parse", "text:s ts:t", S.with_(S.hourly())
       + "SELECT strftime(ts, '%Y-%m-%dT%H:%MZ') AS text, ts FROM (SELECT DISTINCT ts FROM panel) d")
def q_ts_parse(spark, sf):
    d = fx.panel_hourly(spark, sf).select("ts").distinct().select(cal.format_ts("ts").alias("text"))
    return d.select("text", cal.parse_ts("text").alias("ts"))


@query("ts_format", "ts:t text:s", S.with_(S.daily(), DAYS)
       + "SELECT ts, strftime(ts, '%Y-%m-%dT%H:%MZ') AS text FROM days")
def q_ts_format(spark, sf):
    d = fx.panel_daily(spark, sf).select("ts").distinct()
    return d.select("ts", cal.format_ts("ts").alias("text"))


@query("date_parts", "ts:t hour:i month:i day_of_week:i month_day:s date:date year:i",
       S.with_(S.daily(), DAYS)
       + f"""SELECT ts, hour(ts) AS hour, month(ts) AS month, {S.dow('ts')} AS day_of_week,
       {S.month_day('ts')} AS month_day, CAST(ts AS DATE) AS date, year(ts) AS year FROM days""")
def q_date_parts(spark, sf):
    return cal.date_parts(fx.panel_daily(spark, sf).select("ts").distinct())


@query("fixed_holiday", "ts:t fixed_holiday:b", S.with_(S.daily(), DAYS)
       + "SELECT ts, " + S.month_day("ts") + " IN (" + S.FIXED_HOLIDAYS_SQL
       + ") AS fixed_holiday FROM days")
def q_fixed_holiday(spark, sf):
    d = fx.panel_daily(spark, sf).select("ts").distinct()
    return d.select("ts", cal.fixed_holiday("ts").alias("fixed_holiday"))


@query("easter_date", "year:i easter:date", S.with_(S.daily())
       + f"SELECT year, {S.easter('year')} AS easter FROM (SELECT DISTINCT year(ts) AS year FROM daily) y")
def q_easter_date(spark, sf):
    y = fx.panel_daily(spark, sf).select(F.year("ts").alias("year")).distinct()
    return y.select("year", cal.easter_date("year").alias("easter"))


@query("calendar", "ts:t is_weekend:i is_holiday:i is_school_holiday:i", S.with_(S.daily(), DAYS)
       + f"""SELECT ts, CAST({S.dow('ts')} IN (5, 6) AS INTEGER) AS is_weekend, CAST({S.is_holiday('ts')} AS INTEGER) AS is_holiday,
       CAST({S.is_school_holiday('ts')} AS INTEGER) AS is_school_holiday FROM days""")
def q_calendar(spark, sf):
    return cal.calendar(fx.panel_daily(spark, sf).select("ts").distinct())


ONEHOT_SPEC = ("ts:t " + " ".join(f"hour_{h}:i" for h in cal.HOUR_DOMAIN) + " "
               + " ".join(f"day_of_week_{d}:i" for d in cal.WEEKDAY_DOMAIN))


@query("one_hot_fixed", ONEHOT_SPEC, S.with_(S.hourly()) + "SELECT ts, "
       + ", ".join(f"CAST(hour(ts) = {h} AS INTEGER) AS hour_{h}" for h in cal.HOUR_DOMAIN) + ", "
       + ", ".join(f"CAST({S.dow('ts')} = {d} AS INTEGER) AS day_of_week_{d}" for d in cal.WEEKDAY_DOMAIN)
       + " FROM (SELECT DISTINCT ts FROM panel) d")
def q_one_hot_fixed(spark, sf):
    d = fx.panel_hourly(spark, sf).select("ts").distinct()
    d = d.select("ts", F.hour("ts").alias("hour"), cal.day_of_week("ts").alias("dow"))
    d = cal.one_hot(d, "hour", cal.HOUR_DOMAIN, "hour", drop=True)
    return cal.one_hot(d, "dow", cal.WEEKDAY_DOMAIN, "day_of_week", drop=True)


@query("one_hot_observed", "ts:t level:s flag:i", S.with_(S.hourly())
       + """SELECT t.ts, 'month_' || CAST(m.month AS VARCHAR) AS level, CAST(month(t.ts) = m.month AS INTEGER) AS flag
FROM (SELECT DISTINCT ts FROM panel) t, (SELECT DISTINCT month(ts) AS month FROM panel) m""")
def q_one_hot_observed(spark, sf):
    d = fx.panel_hourly(spark, sf).select("ts").distinct().withColumn("month", F.month("ts"))
    return cal.one_hot_observed(d, "month")


ATTR_SPEC = "ts:t " + " ".join(f"{a}:i" for a in cal.ATTRIBUTE_NAMES)


@query("attributes", ATTR_SPEC, S.with_(S.hourly())
       + f"SELECT ts, {S.attribute_select('ts')} FROM (SELECT DISTINCT ts FROM panel) d")
def q_attributes(spark, sf):
    return cal.attributes(fx.panel_hourly(spark, sf))


@query("stream_features", "series:s value:d scaled:d " + ATTR_SPEC,
       S.with_(S.hourly(), "every AS (SELECT *, 'x' AS role FROM panel)", S.scaler("stats", "scaled_rows", "every"))
       + f"SELECT series, ts, value, scaled, {S.attribute_select('ts')} FROM scaled_rows")
def q_stream_features(spark, sf):
    # The panel's files as a stream in micro-batches, calendar and scaler applied, read back from the file sink.
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    fx.panel_hourly(spark, sf).repartitionByRange(8, "ts").write.parquet(source)
    p = spark.read.parquet(source)
    rows = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 4).parquet(source)
    start_featurizer(rows, scale.fit_scaler(p), out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- 2.4 joins


@query("join_attributes", "series:s ts:t value:d window_id:i " + " ".join(f"{a}:i" for a in cal.ATTRIBUTE_NAMES),
       S.with_(S.hourly(), S.with_pos("pp", "panel"), S.gap_windows("win", "pp", S_TRAIN, S_PREDICT, S_GAP),
               f"attrs AS (SELECT ts, {S.attribute_select('ts')} FROM (SELECT DISTINCT ts FROM panel) d)")
       + "SELECT w.series, w.ts, w.value, w.window_id, a.* EXCLUDE (ts) FROM win w LEFT JOIN attrs a USING (ts)"
       + " WHERE w.role = 'x'")
def q_join_attributes(spark, sf):
    p = fx.panel_hourly(spark, sf)
    w = windows.gap_windows(p, S_TRAIN, S_PREDICT, S_GAP).where(F.col("role") == "x")
    return joins.with_attributes(w.select("series", "ts", "value", "window_id"), cal.attributes(p))


@query("semi_timestamps", "ts:t is_holiday:i is_school_holiday:i",
       S.with_(S.hourly(), S.sparse(),
               f"""attrs AS (SELECT ts, CAST({S.is_holiday('ts')} AS INTEGER) AS is_holiday,
       CAST({S.is_school_holiday('ts')} AS INTEGER) AS is_school_holiday FROM (SELECT DISTINCT ts FROM panel) d)""")
       + "SELECT * FROM attrs WHERE ts IN (SELECT ts FROM sparse)")
def q_semi_timestamps(spark, sf):
    attrs = cal.calendar(fx.panel_hourly(spark, sf).select("ts").distinct()).drop("is_weekend")
    x = fx.panel_hourly_sparse(spark, sf)
    return joins.semi_timestamps(attrs, x)


# ---------------------------------------------------------------- 2.5 positions / windows / lags


@query("row_position", LONG + " pos:i",
       S.with_(S.sparse(), S.drop_incomplete("di", "sparse"), S.with_pos("pp", "di"))
       + "SELECT series, ts, value, pos FROM pp")
def q_row_position(spark, sf):
    return position.with_pos(panel.drop_incomplete(fx.panel_hourly_sparse(spark, sf)))


@query("row_position_events", "event_id:i event_type:s pos:i", """SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS pos FROM events""")
def q_row_position_events(spark, sf):
    # The raw events: an irregular axis, numbered by ranges.
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts")
    return position.number_rows_by_range(ev, "ts", ["event_type"], ["event_id"])


WIN_SPEC = LONG + " pos:i window_id:i offset:i role:s"


@query("gap_windows", WIN_SPEC,
       S.with_(S.sparse(), S.drop_incomplete("di", "sparse"), S.with_pos("pp", "di"),
               S.gap_windows("win", "pp", S_TRAIN, S_PREDICT, S_GAP))
       + 'SELECT series, ts, value, pos, window_id, "offset", role FROM win')
def q_gap_windows(spark, sf):
    p = panel.drop_incomplete(fx.panel_hourly_sparse(spark, sf))
    return windows.gap_windows(p, S_TRAIN, S_PREDICT, S_GAP)


BLOCK_SQL = S.with_(S.hourly(), S.test_panel(), S.with_pos("tp", "testp")) + """
SELECT series, ts, value, pos // 52 AS block_id, pos % 52 AS block_offset,
       CASE WHEN pos % 52 < 48 THEN 'x' ELSE 'y' END AS role FROM tp"""


@query("test_blocks", LONG + " block_id:i block_offset:i role:s", BLOCK_SQL)
def q_test_blocks(spark, sf):
    return windows.test_blocks(fx.test_panel(fx.panel_hourly(spark, sf))).drop("pos")


@query("target_timestamps", "ts:t block_id:i horizon:i",
       S.with_(S.hourly(), S.test_panel(), S.with_pos("tp", "testp"))
       + "SELECT DISTINCT ts, pos // 52 AS block_id, pos % 52 - 48 AS horizon FROM tp WHERE pos % 52 >= 48")
def q_target_timestamps(spark, sf):
    b = windows.test_blocks(fx.test_panel(fx.panel_hourly(spark, sf)))
    return windows.target_timestamps(b).select("ts", "block_id", "horizon").distinct()


SHIFT_SQL = """sh AS (
  SELECT series, ts, value,
         lag(value, 1) OVER (PARTITION BY series ORDER BY ts) AS prev_1_value,
         lag(value, 2) OVER (PARTITION BY series ORDER BY ts) AS prev_2_value,
         lag(ts, 1) OVER (PARTITION BY series ORDER BY ts) AS prev_ts
  FROM sparse)"""


@query("shift_rows", LONG + " prev_1_value:d prev_2_value:d",
       S.with_(S.sparse(), SHIFT_SQL) + "SELECT * EXCLUDE (prev_ts) FROM sh")
def q_shift_rows(spark, sf):
    return lags.shift_rows(fx.panel_hourly_sparse(spark, sf), [1, 2])


@query("time_delta", LONG + " delta_hours:d",
       S.with_(S.sparse(), SHIFT_SQL)
       + "SELECT series, ts, value, (epoch(ts) - epoch(prev_ts)) / 3600.0 AS delta_hours FROM sh")
def q_time_delta(spark, sf):
    s = lags.shift_rows(fx.panel_hourly_sparse(spark, sf), [1], with_prev_ts=True)
    return lags.delta_hours(s).select("series", "ts", "value", "delta_hours")


@query("continuity_mask", LONG + " prev_1_value:d prev_2_value:d",
       S.with_(S.sparse(), SHIFT_SQL) + """SELECT series, ts, value,
       CASE WHEN (epoch(ts) - epoch(prev_ts)) / 3600.0 = 1 THEN prev_1_value END AS prev_1_value,
       CASE WHEN (epoch(ts) - epoch(prev_ts)) / 3600.0 = 1 THEN prev_2_value END AS prev_2_value FROM sh""")
def q_continuity_mask(spark, sf):
    return lags.shift_continuous(fx.panel_hourly_sparse(spark, sf), [1, 2], strict=False)


# Flagship windows (48/4/26 on the complete hours of the hourly grid), scaled.
FLAG_CTES = [S.hourly(), S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"),
             S.gap_windows("win", "pp", TRAIN, PREDICT, GAP), S.scaler("stats", "scaled", "win")]


def _flag_windows(spark, sf):
    return forecast.windowed(fx.panel_hourly(spark, sf), TRAIN, PREDICT, GAP)


def _flag_seq(spark, sf):
    return sequences.sequences(_flag_windows(spark, sf), train=TRAIN, predict=PREDICT)


@query("sequence_1", "series:s window_id:i x:ad y:ad",
       S.with_(*FLAG_CTES, S.sequences("seq", "scaled")) + "SELECT * FROM seq")
def q_sequence_1(spark, sf):
    return _flag_seq(spark, sf)


@query("sequence_1_stored", "series:s window_id:i x:ad y:ad",
       S.with_(*FLAG_CTES, S.sequences("seq", "scaled")) + "SELECT * FROM seq")
def q_sequence_1_stored(spark, sf):
    stored = layout.write_stored_panel(panel.drop_incomplete(fx.panel_hourly(spark, sf)), scratch_path(spark, "layout"),
                                       layout.stretch_rows_for(TRAIN, PREDICT, GAP, windows=4))
    return layout.stored_sequences(stored, TRAIN, PREDICT, GAP)


def _attr_windows(spark, sf):
    p = fx.panel_hourly(spark, sf)
    w = windows.gap_windows(panel.drop_incomplete(p), TRAIN, PREDICT, GAP)
    w = scale.apply_scaler(w, scale.fit_scaler(w, where=F.col("role") == "x"))
    return joins.with_attributes(w, cal.attributes(p))


ATTR_CTES = [S.hourly(), S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"),
              S.gap_windows("win", "pp", TRAIN, PREDICT, GAP), S.scaler("stats", "scaled", "win"),
              f"attrs AS (SELECT ts, {S.attribute_select('ts')} FROM (SELECT DISTINCT ts FROM panel) d)",
              "wa AS (SELECT * FROM scaled LEFT JOIN attrs USING (ts))"]
ARR = ", ".join(f"CAST({a} AS DOUBLE)" for a in cal.ATTRIBUTE_NAMES)


@query("sequence_multi", "series:s window_id:i x:aad y:ad", S.with_(*ATTR_CTES) + f"""
SELECT * FROM (SELECT series, window_id,
    list([scaled, {ARR}] ORDER BY "offset") FILTER (WHERE role = 'x') AS x,
    list(value ORDER BY "offset") FILTER (WHERE role = 'y') AS y
  FROM wa GROUP BY series, window_id) g WHERE len(x) = {TRAIN} AND len(y) = {PREDICT}""")
def q_sequence_multi(spark, sf):
    return sequences.sequences(_attr_windows(spark, sf), attrs=cal.ATTRIBUTE_NAMES,
                               train=TRAIN, predict=PREDICT)


TWO_FAM_SQL = f"""two AS (SELECT * FROM (SELECT series, window_id,
    list(scaled ORDER BY "offset") FILTER (WHERE role = 'x') AS x,
    list([{ARR}] ORDER BY "offset") FILTER (WHERE role = 'x') AS x_attrs,
    list(value ORDER BY "offset") FILTER (WHERE role = 'y') AS y
  FROM wa GROUP BY series, window_id) g WHERE len(x) = {TRAIN} AND len(y) = {PREDICT})"""


def _two_family(spark, sf):
    return sequences.sequences(_attr_windows(spark, sf), attrs=cal.ATTRIBUTE_NAMES, families=True,
                               train=TRAIN, predict=PREDICT)


@query("sequence_two_family", "series:s window_id:i x:ad x_attrs:aad y:ad",
       S.with_(*ATTR_CTES, TWO_FAM_SQL) + "SELECT * FROM two")
def q_sequence_two_family(spark, sf):
    return _two_family(spark, sf)


@query("sequence_flatten", "series:s window_id:i x_all:ad",
       S.with_(*ATTR_CTES, TWO_FAM_SQL) + "SELECT series, window_id, list_concat(x, flatten(x_attrs)) AS x_all FROM two")
def q_sequence_flatten(spark, sf):
    return sequences.concat_families(_two_family(spark, sf)).select("series", "window_id", "x_all")


# ---------------------------------------------------------------- 2.6 scaler / metrics


@query("scaler_fit", "series:s n:i mean:d std:d", S.with_(*FLAG_CTES) + "SELECT * FROM stats")
def q_scaler_fit(spark, sf):
    p = panel.drop_incomplete(fx.panel_hourly(spark, sf))
    w = windows.gap_windows(p, TRAIN, PREDICT, GAP)
    return scale.fit_scaler(w, where=F.col("role") == "x")


@query("scaler_apply", "series:s ts:t role:s scaled:d",
       S.with_(*FLAG_CTES) + "SELECT series, ts, role, scaled FROM scaled")
def q_scaler_apply(spark, sf):
    return _flag_windows(spark, sf).select("series", "ts", "role", "scaled")


@query("scaler_inverse", "series:s ts:t value:d restored:d",
       S.with_(*FLAG_CTES) + "SELECT series, ts, value, scaled * std + mean AS restored FROM scaled JOIN stats USING (series)")
def q_scaler_inverse(spark, sf):
    p = panel.drop_incomplete(fx.panel_hourly(spark, sf))
    w = windows.gap_windows(p, TRAIN, PREDICT, GAP)
    st = scale.fit_scaler(w, where=F.col("role") == "x")
    s = scale.apply_scaler(w, st)
    return scale.invert_scaler(s, st, col="scaled", out="restored").select("series", "ts", "value", "restored")


UNI_CTES = FLAG_CTES + [S.sequences("seq", "scaled"), S.horizon_rows("hr", "seq"), S.univariate_fit("model", "hr"),
                        """pred AS (SELECT hr.series, hr.window_id, hr.horizon,
       CASE WHEN m.intercept + m.slope * hr.feature IS NULL THEN NULL
            ELSE greatest(m.intercept + m.slope * hr.feature, 0) END AS prediction, hr.target
  FROM hr LEFT JOIN model m USING (series, horizon))"""]


def _uni_pred(spark, sf):
    seq = materialize(_flag_seq(spark, sf), "sequences")  # read by the fit and by the scores
    return univariate.predict_univariate(seq, univariate.fit_univariate(seq))


@query("forecast_univariate", "series:s mse:d n:i",
       S.with_(*UNI_CTES) + "SELECT series, avg(pow(prediction - target, 2)) AS mse, count(pow(prediction - target, 2)) AS n FROM pred GROUP BY series")
def q_forecast_univariate(spark, sf):
    return forecast.univariate_scores(fx.panel_hourly(spark, sf), TRAIN, PREDICT, GAP)


@query("forecast_univariate_stored", "series:s mse:d n:i",
       S.with_(*UNI_CTES) + "SELECT series, avg(pow(prediction - target, 2)) AS mse, count(pow(prediction - target, 2)) AS n FROM pred GROUP BY series")
def q_forecast_univariate_stored(spark, sf):
    # The flagship flow read from the bucketed layout.
    seq = materialize(q_sequence_1_stored(spark, sf), "sequences").drop("stretch")
    return metrics.mse(univariate.predict_univariate(seq, univariate.fit_univariate(seq)), ["series"])


@query("mse_by_key", "series:s horizon:i mse:d n:i",
       S.with_(*UNI_CTES) + "SELECT series, horizon, avg(pow(prediction - target, 2)) AS mse, count(*) AS n FROM pred GROUP BY series, horizon")
def q_mse_by_key(spark, sf):
    return metrics.mse(_uni_pred(spark, sf), ["series", "horizon"])


@query("scatter_predictions", "series:s ts:t horizon:i prediction:d",
       S.with_(*UNI_CTES) + """SELECT p.series, w.ts, p.horizon, p.prediction FROM pred p
JOIN win w ON w.series = p.series AND w.window_id = p.window_id AND w."offset" = p.horizon + 48""")
def q_scatter_predictions(spark, sf):
    w = _flag_windows(spark, sf)
    seq = materialize(sequences.sequences(w, train=TRAIN, predict=PREDICT), "sequences")
    pred = univariate.predict_univariate(seq, univariate.fit_univariate(seq))
    vec = pred.groupBy("series", "window_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("horizon", "prediction"))),
                    lambda s: s["prediction"]).alias("prediction"))
    flat = sequences.explode_horizon(vec)
    tgt = (w.where(F.col("role") == "y")
           .select("series", "window_id", (F.col("offset") - TRAIN).alias("horizon"), "ts"))
    return flat.join(tgt, ["series", "window_id", "horizon"]).select("series", "ts", "horizon", "prediction")


# ---------------------------------------------------------------- 2.7 splits


@query("split_windows", "series:s window_id:i split:s",
       S.with_(*FLAG_CTES[:4]) + """SELECT DISTINCT series, window_id,
  CASE WHEN window_id < floor((SELECT count(DISTINCT window_id) FROM win) * 0.8) THEN 'train' ELSE 'val' END AS split
FROM win""")
def q_split_windows(spark, sf):
    p = panel.drop_incomplete(fx.panel_hourly(spark, sf))
    w = windows.gap_windows(p, TRAIN, PREDICT, GAP)
    return windows.split_windows(w).select("series", "window_id", "split").distinct()


@query("split_rows", LONG + " pos:i split:s",
       S.with_(S.hourly(), S.with_pos("pp", "panel")) + """SELECT series, ts, value, pos,
  CASE WHEN pos < floor((SELECT max(pos) + 1 FROM pp) * 0.8) THEN 'train' ELSE 'val' END AS split FROM pp""")
def q_split_rows(spark, sf):
    return windows.split_rows(fx.panel_hourly(spark, sf))


# Five blocks over all windows of the daily panel; ceil(fold * nw / 5) is a block's first window.
DAILY_CTES = [S.daily("orders_daily"), "panel AS (SELECT series, ts, value / 1e6 AS value FROM orders_daily)"]
FOLD_SQL = ["foldcount AS (SELECT max(window_id) + 1 AS nw FROM win)",
             f"""folded AS (SELECT win.*, nw, CAST(window_id * {FOLDS} // nw AS INTEGER) AS fold FROM win, foldcount)""",
             f"""placed AS (SELECT *, (fold * nw + {FOLDS - 1}) // {FOLDS} AS first_window,
  ((fold + 1) * nw + {FOLDS - 1}) // {FOLDS} - (fold * nw + {FOLDS - 1}) // {FOLDS} AS block_size FROM folded)""",
             """folds AS (SELECT * EXCLUDE (nw, first_window, block_size),
  CASE WHEN window_id - first_window < greatest(1, least(block_size - 1, floor(block_size * 0.8)))
       THEN 'train' ELSE 'val' END AS fold_role FROM placed)"""]
FOLD_CTES = [*DAILY_CTES, S.with_pos("pp", "panel"), S.gap_windows("win", "pp", TRAIN, PREDICT, GAP),
             *FOLD_SQL]


def _folds(spark, sf):
    w = windows.gap_windows(fx.panel_daily_millions(spark, sf), TRAIN, PREDICT, GAP)
    return windows.blocked_folds(w, k=FOLDS, train_share=0.8)


@query("blocked_folds", "series:s ts:t window_id:i role:s fold:i fold_role:s",
       S.with_(*FOLD_CTES) + "SELECT series, ts, window_id, role, fold, fold_role FROM folds")
def q_blocked_folds(spark, sf):
    return _folds(spark, sf).select("series", "ts", "window_id", "role", "fold", "fold_role")


@query("blocked_folds_stored", "series:s ts:t window_id:i role:s fold:i fold_role:s",
       S.with_(*FOLD_CTES) + "SELECT series, ts, window_id, role, fold, fold_role FROM folds")
def q_blocked_folds_stored(spark, sf):
    stored = layout.write_stored_panel(fx.panel_daily_millions(spark, sf), scratch_path(spark, "layout"),
                                       layout.stretch_rows_for(TRAIN, PREDICT, GAP, windows=4), halo_seconds=2 * 86400)
    w = windows.blocked_folds(layout.stored_windows(stored, TRAIN, PREDICT, GAP), k=FOLDS, train_share=0.8)
    return w.select("series", "ts", "window_id", "role", "fold", "fold_role")


@query("shuffled_folds", "ts:t fold:i", S.with_(S.hourly())
       + """SELECT ts, CAST(CAST('0x' || substring(md5(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
FROM (SELECT DISTINCT ts FROM panel) t""")
def q_shuffled_folds(spark, sf):
    d = fx.panel_hourly(spark, sf).select("ts").distinct()
    return windows.hashed_folds(d, k=5, seed=42)


@query("sink_fold_slices", "series:s ts:t window_id:i role:s fold:i fold_role:s",
       S.with_(*FOLD_CTES) + "SELECT series, ts, window_id, role, fold, fold_role FROM folds")
def q_sink_fold_slices(spark, sf):
    path = scratch_path(spark, "folds")
    io.write_folds(_folds(spark, sf).select("series", "ts", "window_id", "role", "fold", "fold_role"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- 2.8 sorts / unions


@query("sort_time", LONG, S.with_(S.sparse()) + "SELECT * FROM sparse ORDER BY ts")
def q_sort_time(spark, sf):
    return panel.sort_time(fx.panel_hourly_sparse(spark, sf))


# ---------------------------------------------------------------- 2.4 / 2.6 / 2.8 cross-validation

UNI_GRID = {"kind": ["mean", "last"], "l2": [0.0, 1.0, 10.0]}
CV_GRID_SQL = "cvgrid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{k}', {l2!r})" for i, (k, l2) in enumerate(
        (k, l2) for k in UNI_GRID["kind"] for l2 in UNI_GRID["l2"])) + ") g(config_id, kind, l2))"

CV_CTES = [*DAILY_CTES, S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"),
           S.gap_windows("win", "pp", TRAIN, PREDICT, GAP),
           *FOLD_SQL,
           CV_GRID_SQL,
           """cvstats AS (SELECT series, fold, avg(value) AS mean,
  CASE WHEN stddev_pop(value) IS NULL OR stddev_pop(value) <= 1e-12 THEN 1.0 ELSE stddev_pop(value) END AS std
  FROM folds WHERE role = 'x' AND fold_role = 'train' GROUP BY series, fold)""",
           "cvscaled AS (SELECT f.*, (f.value - s.mean) / s.std AS scaled FROM folds f LEFT JOIN cvstats s USING (series, fold))",
           f"""cvseq AS (SELECT * FROM (SELECT series, fold, fold_role, window_id,
    list(scaled ORDER BY "offset") FILTER (WHERE role = 'x') AS x,
    list(value ORDER BY "offset") FILTER (WHERE role = 'y') AS y
  FROM cvscaled GROUP BY series, fold, fold_role, window_id) g WHERE len(x) = {TRAIN} AND len(y) = {PREDICT})""",
           """cvrows AS (SELECT s.series, s.fold, s.fold_role, s.window_id, g.config_id, g.kind, g.l2,
    CASE WHEN g.kind = 'last' THEN s.x[len(s.x)] ELSE list_sum(s.x) / len(s.x) END AS feature,
    unnest(s.y) AS target, CAST(generate_subscripts(s.y, 1) - 1 AS INTEGER) AS horizon
  FROM cvseq s, cvgrid g)""",
           """cvagg AS (SELECT series, fold, config_id, kind, l2, horizon, count(*) AS n,
    covar_pop(target, feature) AS cxy, var_pop(feature) AS vx, avg(feature) AS mx, avg(target) AS my
  FROM cvrows WHERE fold_role = 'train' AND feature IS NOT NULL AND target IS NOT NULL
  GROUP BY series, fold, config_id, kind, l2, horizon)""",
           """cvmodel AS (SELECT *, my - slope * mx AS intercept FROM (
  SELECT *, CASE WHEN vx * n + l2 <> 0 THEN cxy * n / (vx * n + l2) ELSE 0 END AS slope FROM cvagg) t)""",
           """cvpred AS (SELECT r.series, r.fold, r.config_id, r.kind, r.l2, r.window_id, r.horizon,
    CASE WHEN m.intercept + m.slope * r.feature IS NULL THEN NULL
         ELSE greatest(m.intercept + m.slope * r.feature, 0) END AS prediction, r.target
  FROM cvrows r LEFT JOIN cvmodel m USING (series, fold, config_id, kind, l2, horizon)
  WHERE r.fold_role = 'val')""",
           """fold_mse AS (SELECT config_id, kind, l2, fold, avg(pow(prediction - target, 2)) AS mse,
    count(pow(prediction - target, 2)) AS n FROM cvpred GROUP BY config_id, kind, l2, fold)""",
           """scores AS (SELECT config_id, kind, l2, CASE WHEN count(mse) = count(*) THEN avg(mse) END AS mse, stddev_pop(mse) AS mse_std,
    count(mse) AS folds FROM fold_mse GROUP BY config_id, kind, l2)"""]
SCORE_SPEC = "config_id:i kind:s l2:d mse:d mse_std:d folds:i"


def _uni_cv(spark, sf):
    grid = joins.param_rows(UNI_GRID)
    return univariate.cross_validate_univariate(fx.panel_daily_millions(spark, sf), grid, TRAIN, PREDICT, GAP,
                                                k=FOLDS, train_share=0.8)


@query("config_fold_series", "config_id:i kind:s l2:d fold:i series:s train_windows:i val_windows:i",
       S.with_(*CV_CTES) + """SELECT g.config_id, g.kind, g.l2, f.fold, f.series, f.train_windows, f.val_windows
FROM (SELECT fold, series, count(DISTINCT window_id) FILTER (WHERE fold_role = 'train') AS train_windows,
             count(DISTINCT window_id) FILTER (WHERE fold_role = 'val') AS val_windows
      FROM folds GROUP BY fold, series) f, cvgrid g""")
def q_config_fold_series(spark, sf):
    grid = joins.param_rows(UNI_GRID)
    fs = (_folds(spark, sf).groupBy("fold", "series")
          .agg(F.count_distinct(F.when(F.col("fold_role") == "train", F.col("window_id"))).alias("train_windows"),
               F.count_distinct(F.when(F.col("fold_role") == "val", F.col("window_id"))).alias("val_windows")))
    return joins.with_grid(fs, grid)


@query("mse_global", "config_id:i kind:s l2:d fold:i mse:d n:i", S.with_(*CV_CTES) + "SELECT * FROM fold_mse")
def q_mse_global(spark, sf):
    return _uni_cv(spark, sf)[0]


@query("cv_score", SCORE_SPEC, S.with_(*CV_CTES) + "SELECT * FROM scores")
def q_cv_score(spark, sf):
    return _uni_cv(spark, sf)[1]


@query("best_config", SCORE_SPEC, S.with_(*CV_CTES) + "SELECT * FROM scores ORDER BY mse, config_id LIMIT 1")
def q_best_config(spark, sf):
    return metrics.best_config(_uni_cv(spark, sf)[1])


@query("sort_scores", SCORE_SPEC, S.with_(*CV_CTES) + "SELECT * FROM scores ORDER BY mse, config_id")
def q_sort_scores(spark, sf):
    return metrics.sort_scores(_uni_cv(spark, sf)[1])


@query("sink_cv_results", SCORE_SPEC, S.with_(*CV_CTES) + "SELECT * FROM scores")
def q_sink_cv_results(spark, sf):
    path = scratch_path(spark, "scores")
    io.write_scores(_uni_cv(spark, sf)[1], path)
    return (spark.read.option("header", True)
            .schema("config_id BIGINT, kind STRING, l2 DOUBLE, mse DOUBLE, mse_std DOUBLE, folds BIGINT")
            .csv(path))


# ---------------------------------------------------------------- 2.9 block prediction and sinks

# Models learn from the first half of the hours and fill blocks of the second half.
HISTORY_SHARE = 0.5
HISTORY_CTES = [S.hourly(), S.with_pos("allpos", "panel"),
                f"cut AS (SELECT CAST(floor((max(pos) + 1) * {HISTORY_SHARE}) AS BIGINT) AS c FROM allpos)",
                "hist AS (SELECT series, ts, value FROM allpos, cut WHERE pos < c)",
                "later AS (SELECT series, ts, value FROM allpos, cut WHERE pos >= c)",
                S.test_panel(src="later")]
PB_TB = """tb AS (SELECT tp.*, pos // 52 AS block_id, CAST(pos % 52 AS INTEGER) AS "offset",
    CASE WHEN pos % 52 < 48 THEN 'x' ELSE 'y' END AS role FROM tp)"""
PB_TBS = "tbs AS (SELECT tb.*, (tb.value - st.mean) / st.std AS scaled FROM tb LEFT JOIN stats st USING (series))"
PB_CTES = HISTORY_CTES + [S.drop_incomplete("di", "hist"), S.with_pos("pp", "di"),
                       S.gap_windows("win", "pp", TRAIN, PREDICT, GAP), S.scaler("stats", "scaled", "win"),
                       S.sequences("seq", "scaled"), S.horizon_rows("hr", "seq"), S.univariate_fit("model", "hr"),
                       S.with_pos("tp", "testp"), PB_TB, PB_TBS,
                       """tseq AS (SELECT * FROM (SELECT series, block_id,
    list(scaled ORDER BY "offset") FILTER (WHERE role = 'x') AS x FROM tbs GROUP BY series, block_id) g
  WHERE len(x) = 48)""",
                       """bpred AS (SELECT s.series, s.block_id, m.horizon, t.ts,
    CASE WHEN m.intercept + m.slope * (list_sum(s.x) / len(s.x)) IS NULL THEN NULL
         ELSE greatest(m.intercept + m.slope * (list_sum(s.x) / len(s.x)), 0) END AS prediction
  FROM tseq s JOIN model m USING (series)
  JOIN tb t ON t.series = s.series AND t.block_id = s.block_id AND t."offset" = m.horizon + 48)"""]


def _history_and_test(spark, sf):
    s = materialize(windows.split_rows(fx.panel_hourly(spark, sf), HISTORY_SHARE))
    part = lambda name: s.where(F.col("split") == name).select("series", "ts", "value")
    return part("train"), fx.test_panel(part("val"))


def _block_pred(history, test):
    model, stats = univariate.train_univariate(history, TRAIN, PREDICT, GAP)
    return univariate.predict_blocks_univariate(test, model, stats, TRAIN, PREDICT)


@query("predict_blocks", "series:s block_id:i horizon:i ts:t prediction:d",
       S.with_(*PB_CTES) + "SELECT * FROM bpred")
def q_predict_blocks(spark, sf):
    return _block_pred(*_history_and_test(spark, sf))


@query("sink_predictions", "timestamp:s " + " ".join(f"{n}:d" for n in SERIES), S.with_(*PB_CTES)
       + "SELECT strftime(ts, '%Y-%m-%dT%H:%MZ') AS timestamp, "
       + ", ".join(f"max(CASE WHEN series = '{n}' THEN prediction END) AS {n}" for n in SERIES) + " FROM bpred GROUP BY timestamp")
def q_sink_predictions(spark, sf):
    path = scratch_path(spark, "pred")
    io.write_predictions(_block_pred(*_history_and_test(spark, sf)).select("series", "ts", "prediction"), path, SERIES)
    return spark.read.option("header", True).csv(path)


@query("update_by_key", LONG, S.with_(*PB_CTES)
       + "SELECT t.series, t.ts, COALESCE(b.prediction, t.value) AS value FROM testp t LEFT JOIN bpred b USING (series, ts)")
def q_update_by_key(spark, sf):
    history, test = _history_and_test(spark, sf)
    return joins.fill_from(test, _block_pred(history, test).select("series", "ts", "prediction"))


@query("unmatched_predictions", "series:s ts:t prediction:d", S.with_(*PB_CTES, S.sparse())
       + "SELECT b.series, b.ts, b.prediction FROM bpred b ANTI JOIN sparse s ON s.series = b.series AND s.ts = b.ts")
def q_unmatched_predictions(spark, sf):
    # Predictions for hours that the panel with holes does not have.
    pred = _block_pred(*_history_and_test(spark, sf)).select("series", "ts", "prediction")
    return joins.unmatched(pred, fx.panel_hourly_sparse(spark, sf))


# ---------------------------------------------------------------- 2.9 lag models

LAG_GRID = {"l2": [0.1, 1.0, 10.0]}
TWO_GRID = {"l2": [0.1, 1.0, 10.0], "l2_attr": [1.0, 10.0]}
PRED_SPEC = "series:s block_id:i horizon:i ts:t prediction:d"
# The inputs of each penalty: all, or the 48 values and the 48 x 45 calendar attributes.
ONE, TWO = {"l2": ""}, {"l2": f"[1:{TRAIN}]", "l2_attr": f"[{TRAIN + 1}:]"}
HOUR_ATTRS = f"attrs AS (SELECT ts, [{ARR}] AS attrs FROM (SELECT ts, {S.attribute_select('ts')} FROM (SELECT DISTINCT ts FROM panel) d) e)"


def _hourly_inputs(name, src, keys, attrs=True, with_y=True):
    """Windows of ``src`` (scaled, offset, role) with all inputs in one list."""
    x = "list(scaled ORDER BY \"offset\") FILTER (WHERE role = 'x')"
    if attrs:
        x = f"list_concat({x}, flatten(list(attrs ORDER BY \"offset\") FILTER (WHERE role = 'x')))"
    y = ", list(value ORDER BY \"offset\") FILTER (WHERE role = 'y') AS y" if with_y else ""
    whole = f" AND len(y) = {PREDICT}" if with_y else ""
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, {x} AS x{y} FROM {src}{' LEFT JOIN attrs USING (ts)' if attrs else ''} GROUP BY {keys}) g
  WHERE len(x) = {TRAIN * (46 if attrs else 1)}{whole})"""


def _blocks_sql(families, config, attrs):
    """Ridge on the windows of the first half, predicted blocks of the second."""
    params = ", ".join(config)
    return S.with_(*PB_CTES[:len(HISTORY_CTES)], *PB_CTES[len(HISTORY_CTES):len(HISTORY_CTES) + 4], S.with_pos("tp", "testp"), PB_TB, PB_TBS, HOUR_ATTRS,
                   _hourly_inputs("train", "scaled", "series, window_id", attrs), _hourly_inputs("target", "tbs", "series, block_id", attrs, False),
                   S.configs([config]), S.dual_ridge("r", "train", "series", families, params), S.dual_predict("rp", "r", "target", "series", families, params, "block_id")) + """
SELECT p.series, p.block_id, p.horizon, t.ts, p.prediction FROM rp p JOIN tb t ON t.series = p.series AND t.block_id = p.block_id AND t."offset" = p.horizon + 48"""


def _lag_blocks(spark, sf, layout, **how):
    history, test = _history_and_test(spark, sf)
    model, stats = lagmodels.fit_lags(history, layout, TRAIN, PREDICT, GAP, l2=1.0, l2_attr=10.0, **how)
    return lagmodels.predict_blocks(test, model, stats, layout, TRAIN, PREDICT)


@query("forecast_lags", PRED_SPEC, _blocks_sql(ONE, {"l2": 1.0}, False))
def q_forecast_lags(spark, sf):
    return _lag_blocks(spark, sf, "lags")


@query("forecast_lags_calendar", PRED_SPEC, _blocks_sql(ONE, {"l2": 1.0}, True))
def q_forecast_lags_calendar(spark, sf):
    # All 48 x 46 inputs, solved window by window.
    return _lag_blocks(spark, sf, "hourly_calendar")


@query("forecast_two_family", PRED_SPEC, _blocks_sql(TWO, {"l2": 1.0, "l2_attr": 10.0}, True))
def q_forecast_two_family(spark, sf):
    # The same inputs with a penalty per family, by conjugate gradients.
    return _lag_blocks(spark, sf, "hourly_two_family", matrix_free=True)


HOLDOUT_SQL = S.with_(S.hourly(), S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"), S.gap_windows("win", "pp", TRAIN, PREDICT, GAP),
                      """split AS (SELECT *, CASE WHEN window_id < floor((SELECT count(DISTINCT window_id) FROM win) * 0.8) THEN 'train' ELSE 'val' END AS split FROM win)""",
                      """sstats AS (SELECT series, avg(value) AS mean, CASE WHEN stddev_pop(value) IS NULL OR stddev_pop(value) <= 1e-12 THEN 1.0 ELSE stddev_pop(value) END AS std
  FROM split WHERE role = 'x' AND split = 'train' GROUP BY series)""",
                      "sscaled AS (SELECT s.*, (s.value - t.mean) / t.std AS scaled FROM split s LEFT JOIN sstats t USING (series))",
                      _hourly_inputs("sseq", "sscaled", "series, split, window_id", False),
                      "train AS (SELECT * FROM sseq WHERE split = 'train')", "target AS (SELECT series, window_id, x, y FROM sseq WHERE split = 'val')",
                      S.configs([{"l2": 1.0}]), S.dual_ridge("r", "train", "series", ONE, "l2"), S.dual_predict("rp", "r", "target", "series", ONE, "l2", "window_id")) + """
SELECT series, avg(pow(prediction - y[horizon + 1], 2)) AS mse, count(*) AS n FROM rp JOIN target USING (series, window_id) GROUP BY series"""


@query("holdout_scores", "series:s mse:d n:i", HOLDOUT_SQL)
def q_holdout_scores(spark, sf):
    # Trained on the first 80 % of the windows, scored on the rest.
    return lagmodels.holdout_scores(fx.panel_hourly(spark, sf), "lags", TRAIN, PREDICT, GAP, l2=1.0)[0]


def _cv_sql(ctes, families, rows, attrs):
    params = ", ".join(rows[0])
    return S.with_(*ctes, HOUR_ATTRS, _hourly_inputs("fseq", "cvscaled", "series, fold, fold_role, window_id", attrs),
                   "train AS (SELECT * FROM fseq WHERE fold_role = 'train')", "target AS (SELECT series, fold, window_id, x, y FROM fseq WHERE fold_role = 'val')",
                   S.configs(rows), S.dual_ridge("r", "train", "series, fold", families, params), S.dual_predict("rp", "r", "target", "series, fold", families, params, "window_id"),
                   f"""rfold AS (SELECT {params}, fold, avg(pow(prediction - y[horizon + 1], 2)) AS mse FROM rp JOIN target USING (series, fold, window_id) GROUP BY {params}, fold)""") + f"""
SELECT {params}, avg(mse) AS mse, stddev_pop(mse) AS mse_std, count(mse) AS folds FROM rfold GROUP BY {params}"""


CV_HEAD = CV_CTES[:CV_CTES.index(CV_GRID_SQL)] + CV_CTES[CV_CTES.index(CV_GRID_SQL) + 1:CV_CTES.index(CV_GRID_SQL) + 3]


@query("cross_validate", "config_id:i l2:d mse:d mse_std:d folds:i", _cv_sql(CV_HEAD, ONE, joins.param_rows(LAG_GRID), False))
def q_cross_validate(spark, sf):
    return lagmodels.cross_validate(fx.panel_daily_millions(spark, sf), joins.param_rows(LAG_GRID), "lags", TRAIN, PREDICT, GAP, k=FOLDS)[1]


@query("cross_validate_calendar", "config_id:i l2:d mse:d mse_std:d folds:i", _cv_sql(CV_HEAD, ONE, joins.param_rows(LAG_GRID), True))
def q_cross_validate_calendar(spark, sf):
    return lagmodels.cross_validate(fx.panel_daily_millions(spark, sf), joins.param_rows(LAG_GRID), "hourly_calendar", TRAIN, PREDICT, GAP, k=FOLDS)[1]


@query("cross_validate_two_family", "config_id:i l2:d l2_attr:d mse:d mse_std:d folds:i", _cv_sql(CV_HEAD, TWO, joins.param_rows(TWO_GRID), True))
def q_cross_validate_two_family(spark, sf):
    # Separate penalties for the values and for the calendar of the input days.
    return lagmodels.cross_validate(fx.panel_daily_millions(spark, sf), joins.param_rows(TWO_GRID), "hourly_two_family", TRAIN, PREDICT, GAP, k=FOLDS)[1]


LOO_CTES = [*DAILY_CTES, S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"), S.gap_windows("win", "pp", TRAIN, PREDICT, GAP), S.scaler("stats", "scaled", "win"),
            _hourly_inputs("all_windows", "scaled", "series, window_id", False),
            # One fold per left-out window.
            "lseq AS (SELECT a.series, h.window_id AS fold, a.window_id, a.window_id = h.window_id AS out, a.x, a.y FROM all_windows a JOIN all_windows h USING (series))",
            "train AS (SELECT * FROM lseq WHERE NOT out)", "target AS (SELECT series, fold, window_id, x, y FROM lseq WHERE out)"]


@query("leave_one_out", "series:s config_id:i l2:d loo_mse:d n:i", S.with_(
    *LOO_CTES, S.configs(joins.param_rows(LAG_GRID)), S.dual_ridge("r", "train", "series, fold", ONE, "config_id, l2"),
    S.dual_predict("rp", "r", "target", "series, fold", ONE, "config_id, l2", "window_id").replace("greatest(any_value(ym[h]) + sum(a * k), 0)", "any_value(ym[h]) + sum(a * k)")) + """
SELECT series, config_id, l2, avg(pow(prediction - y[horizon + 1], 2)) AS loo_mse, count(DISTINCT window_id) AS n FROM rp JOIN target USING (series, fold, window_id) GROUP BY ALL""")
def q_leave_one_out(spark, sf):
    # Leave-one-window-out error of every penalty from one decomposition per series.
    return lagmodels.leave_one_out(fx.panel_daily_millions(spark, sf), joins.param_rows(LAG_GRID), "lags", TRAIN, PREDICT, GAP)


# Many series: every user is one.

USERS = S.hourly(series="user_id")


@query("lag_join_users", LAGGED_SPEC, S.with_(USERS, LAGGED_SQL.replace("sparse", "panel")) + "SELECT * FROM lagged")
def q_lag_join_users(spark, sf):
    return lags.lag_features(fx.panel_users(spark, sf), [1, 2])


@query("forecast_lags_users", PRED_SPEC, _blocks_sql(ONE, {"l2": 1.0}, False).replace(S.hourly(), USERS))
def q_forecast_lags_users(spark, sf):
    s = materialize(windows.split_rows(fx.panel_users(spark, sf), HISTORY_SHARE))
    part = lambda name: s.where(F.col("split") == name).select("series", "ts", "value")
    model, stats = lagmodels.fit_lags(part("train"), "lags", TRAIN, PREDICT, GAP, l2=1.0)
    return lagmodels.predict_blocks(fx.test_panel(part("val")), model, stats, "lags", TRAIN, PREDICT)


USER_FOLDS = 4  # nine windows
USER_CV = [USERS, *[c.replace(f"* {FOLDS}", f"* {USER_FOLDS}").replace(f"// {FOLDS}", f"// {USER_FOLDS}").replace(f"+ {FOLDS - 1})", f"+ {USER_FOLDS - 1})") for c in CV_HEAD[len(DAILY_CTES):]]]


@query("cross_validate_users", "config_id:i l2:d mse:d mse_std:d folds:i", _cv_sql(USER_CV, ONE, joins.param_rows(LAG_GRID), False))
def q_cross_validate_users(spark, sf):
    return lagmodels.cross_validate(fx.panel_users(spark, sf), joins.param_rows(LAG_GRID), "lags", TRAIN, PREDICT, GAP, k=USER_FOLDS)[1]


# ---------------------------------------------------------------- 2.9 recursive fill, all-series model

REC_STEPS = 4
REC_ONLY = [
    """lag1 AS (SELECT p.series, p.ts, p.value, l.value AS value_lag1 FROM hist p
  LEFT JOIN hist l ON l.series = p.series AND l.ts + INTERVAL 1 HOUR = p.ts)""",
    """rmodel AS (SELECT series, regr_slope(value, value_lag1) AS slope,
  regr_intercept(value, value_lag1) AS intercept FROM lag1 GROUP BY series)""",
    "t0 AS (SELECT series, ts, value FROM testp)"]
for _k in range(1, REC_STEPS + 1):
    REC_ONLY.append(f"""r{_k} AS (SELECT {_k} AS step, c.series, c.ts, m.intercept + m.slope * pv.value AS prediction
  FROM t{_k - 1} c JOIN t{_k - 1} pv ON pv.series = c.series AND pv.ts + INTERVAL 1 HOUR = c.ts
  JOIN rmodel m ON m.series = c.series
  WHERE c.ts IN (SELECT ts FROM t{_k - 1} GROUP BY ts HAVING count(value) = 0) AND pv.value IS NOT NULL)""")
    REC_ONLY.append(f"""t{_k} AS (SELECT c.series, c.ts, COALESCE(r.prediction, c.value) AS value
  FROM t{_k - 1} c LEFT JOIN r{_k} r USING (series, ts))""")
REC_UNION = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(1, REC_STEPS + 1))


def _recursive(history, test):
    from hourglass.plans import recursive
    return recursive.recursive_fill_lag1(test, recursive.lag1_linear_model(history), steps=REC_STEPS)


@query("forecast_recursive", "step:i series:s ts:t prediction:d",
       S.with_(*HISTORY_CTES, *REC_ONLY) + REC_UNION)
def q_forecast_recursive(spark, sf):
    return _recursive(*_history_and_test(spark, sf))


@query("forecast_recursive_all", "step:i series:s ts:t prediction:d")
def q_forecast_recursive_all(spark, sf):
    # The all-series model with both lags of every series, fitted on the history.
    from hourglass.plans import global_model, recursive
    history, test = _history_and_test(spark, sf)
    names = global_model.series_names(history)
    model = global_model.fit_targets(materialize(global_model.wide_samples(history, names)), names, l1=1e-3)
    return recursive.recursive_fill(test, global_model.recursive_predictor(model, len(names)), steps=REC_STEPS, lags=(1, 2))


@query("union_predictions", "model:s series:s ts:t prediction:d",
       S.with_(*PB_CTES, *REC_ONLY) + "SELECT 'univariate' AS model, series, ts, prediction FROM bpred UNION ALL "
       + "SELECT 'recursive' AS model, series, ts, prediction FROM (" + REC_UNION + ") r")
def q_union_predictions(spark, sf):
    history, test = _history_and_test(spark, sf)
    return forecast.stack_predictions({"univariate": _block_pred(history, test), "recursive": _recursive(history, test)})


MATRIX_FEATURES = [*cal.ATTRIBUTE_NAMES, "value_lag1", "value_lag2"]


@query("scaler_fit_matrix", "feature:s mean:d std:d", S.with_(
    S.sparse(), LAGGED_SQL, f"la AS (SELECT value_lag1, value_lag2, {S.attribute_select('ts')} FROM lagged)") + " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, avg(x) AS mean,
  CASE WHEN stddev_pop(x) IS NULL OR stddev_pop(x) <= 1e-12 THEN 1.0 ELSE stddev_pop(x) END AS std
FROM (SELECT CAST({name} AS DOUBLE) AS x FROM la) t""" for name in MATRIX_FEATURES))
def q_scaler_fit_matrix(spark, sf):
    feats = joins.with_attributes(_lagged(spark, sf), cal.attributes(fx.panel_hourly(spark, sf)))
    return scale.fit_scaler_matrix(feats.select(*[F.col(c).cast("double").alias(c) for c in MATRIX_FEATURES]), MATRIX_FEATURES)


def _global(spark, sf):
    from hourglass.plans import global_model
    return global_model.fit_global(fx.panel_hourly(spark, sf), l1=1e-3)


@query("forecast_all_series", "series:s mse:d n:i")
def q_forecast_all_series(spark, sf):
    return _global(spark, sf)[1]


@query("forecast_all_series_users", "series:s mse:d n:i")
def q_forecast_all_series_users(spark, sf):
    # As many targets as users, all from one Gram matrix.
    from hourglass.plans import global_model
    return global_model.fit_global(fx.panel_users(spark, sf), l1=1e-2)[1]


@query("forecast_all_series_trees", "series:s mse:d n:i mse_linear:d")
def q_forecast_all_series_trees(spark, sf):
    # Held-out error of boosted trees beside that of the L1 regressions.
    from hourglass.plans import global_model, trees
    p = fx.panel_hourly(spark, sf)
    linear = global_model.fit_global(p, l1=1e-3)[1].select("series", F.col("mse").alias("mse_linear"))
    return trees.fit_trees(p)[1].join(linear, "series")


@query("feature_importance_trees", "feature:s importance:d")
def q_feature_importance_trees(spark, sf):
    from hourglass.plans import trees
    return trees.fit_trees(fx.panel_hourly(spark, sf))[2]


@query("feature_importance", "feature:s importance:d")
def q_feature_importance(spark, sf):
    from hourglass.plans import global_model
    model, _, names = _global(spark, sf)
    return global_model.feature_importance(model, global_model.feature_names(names), k=None)


@query("top_weights", "feature:s importance:d")
def q_top_weights(spark, sf):
    from hourglass.plans import global_model
    model, _, names = _global(spark, sf)
    return global_model.feature_importance(model, global_model.feature_names(names), k=11)


ATTRIBUTION_CTES = [S.hourly(), S.drop_incomplete("di", "panel"), S.with_pos("pp", "di"), S.gap_windows("win", "pp", TRAIN, PREDICT, GAP), S.scaler("stats", "scaled", "win")]
# Weight of every input: the dual weights on the windows, over the penalty; contributions are |f - mean| times the mean size of the weights.
ATTRIBUTION_SQL = """cells AS (SELECT al.series, generate_subscripts(al.x, 1) AS i, unnest(al.x) AS v, al.i AS w, al.a FROM r_alpha al),
weights AS (SELECT series, i, h, sum(v * a[h] / {l2}) AS coef FROM (SELECT *, unnest(generate_series(1, 4)) AS h FROM cells) e GROUP BY series, i, h),
sizes AS (SELECT series, i, avg(abs(coef)) AS size FROM weights GROUP BY series, i),
means AS (SELECT series, i, avg(v) AS fmean FROM cells GROUP BY series, i),
per_place AS (SELECT c.series, c.i, avg(abs(c.v - m.fmean)) * any_value(s.size) AS part FROM cells c JOIN means m USING (series, i) JOIN sizes s USING (series, i) GROUP BY c.series, c.i)"""


def _attribution(spark, sf, layout, names=None, top=10):
    from hourglass.plans import global_model
    p = fx.panel_hourly(spark, sf)
    model, stats = lagmodels.fit_lags(p, layout, TRAIN, PREDICT, GAP, l2=1.0)
    w = windows.gap_windows(panel.drop_incomplete(p), TRAIN, PREDICT, GAP)
    smp = lagmodels.samples(scale.apply_scaler(w, stats), layout, ["series"], TRAIN, PREDICT)
    return global_model.attribution(smp, model, ["series"], top, names)


@query("attribution", "series:s feature:i mean_abs_contribution:d rank:i", S.with_(
    *ATTRIBUTION_CTES, HOUR_ATTRS, _hourly_inputs("train", "scaled", "series, window_id", False), S.configs([{"l2": 1.0}]),
    S.dual_ridge("r", "train", "series", ONE, "l2"), ATTRIBUTION_SQL.format(l2="al.l2").replace("/ al.l2", "/ 1.0")) + """
SELECT * FROM (SELECT series, i - 1 AS feature, part AS mean_abs_contribution, row_number() OVER (PARTITION BY series ORDER BY part DESC, i) AS rank FROM per_place) t WHERE rank <= 10""")
def q_attribution(spark, sf):
    return _attribution(spark, sf, "lags")


#: Of every input the feature it belongs to: the value, or a calendar attribute, at each of the 48 hours.
INPUT_NAMES = ["value"] * TRAIN + list(cal.ATTRIBUTE_NAMES) * TRAIN
INPUT_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in cal.ATTRIBUTE_NAMES) + "]"


@query("attribution_calendar", "series:s feature:s mean_abs_contribution:d", S.with_(
    *ATTRIBUTION_CTES, HOUR_ATTRS, _hourly_inputs("train", "scaled", "series, window_id", True), S.configs([{"l2": 1.0}]),
    S.dual_ridge("r", "train", "series", ONE, "l2"), ATTRIBUTION_SQL.format(l2="1.0"),
    f"""named AS (SELECT series, CASE WHEN i <= {TRAIN} THEN 'value' ELSE {INPUT_NAMES_SQL}[(i - {TRAIN} - 1) % 45 + 1] END AS feature, avg(part) AS part FROM per_place GROUP BY 1, 2)""") + """
SELECT series, feature, part AS mean_abs_contribution FROM named""")
def q_attribution_calendar(spark, sf):
    # The joined features, each averaged over the 48 hours.
    return _attribution(spark, sf, "hourly_calendar", INPUT_NAMES, top=None)
