"""Fixture panels derived by Spark from the driver's test tables.

These only put the test tables into the long panel schema
``(series STRING, ts TIMESTAMP, value DOUBLE)``; none of the forecasting
work happens here.  Every builder is one aggregation (map-side partial
combine, so a hot series or hour does not land in one task) and grows
with its input table.  Each panel is materialized once (reliable
checkpoint): the operators downstream read it several times (scalar
subqueries, semi-joins, position tables) and must not rescan the raw table
for each read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourglass.functions.numeric import nan_to_null
from hourglass.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # events.ts is TIMESTAMP_NTZ; in a UTC session the cast keeps the wall clock.
    return _table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"), F.col("event_type"), nan_to_null("value").alias("value"))


def _grid_counts(keyed: DataFrame, unit: str, step: str) -> DataFrame:
    """Count rows per (series, truncated ts) on the full grid min..max, 0 where absent.

    Rows are counted by (series, ts), which has no hot key even when one
    series is hot.  The counts of a series, at most one per grid time, are
    then put in order, and each fills the grid up to the next one (the first
    also from the global bound, a scalar subquery): only occupied times are
    shuffled, never the grid.
    """
    b = keyed.select(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    unit_step = F.expr(f"INTERVAL 1 {step}")
    at = Window.partitionBy("series").orderBy("ts")
    counts = keyed.groupBy("series", "ts").agg(F.count(F.lit(1)).cast("double").alias("n"))
    spans = counts.select("series", "n", F.col("ts").alias("_at"),
                          F.when(F.lag("ts").over(at).isNull(), b["lo"]).otherwise(F.col("ts")).alias("_from"),
                          F.coalesce(F.lead("ts").over(at) - unit_step, b["hi"]).alias("_to"))
    grid = spans.select("series", "n", "_at", F.explode(F.sequence("_from", "_to", unit_step)).alias("ts"))
    return materialize(grid.select("series", "ts", F.when(F.col("ts") == F.col("_at"), F.col("n")).otherwise(F.lit(0.0)).alias("value")))


def panel_hourly(spark: SparkSession, sf_dir: str, series_col: str = "event_type") -> DataFrame:
    """Hourly event counts per ``series_col`` on the full hour grid, 0 where absent."""
    ev = _events(spark, sf_dir).where(F.col("ts").isNotNull() & F.col(series_col).isNotNull())
    keyed = ev.select(F.col(series_col).cast("string").alias("series"),
                      F.date_trunc("hour", "ts").alias("ts"))
    return _grid_counts(keyed, "hour", "HOUR")


def panel_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts per user (many series) on the full hour grid."""
    return panel_hourly(spark, sf_dir, series_col="user_id")


def panel_hourly_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per (event_type, hour), only hours that occur."""
    ev = _events(spark, sf_dir).where(F.col("ts").isNotNull() & F.col("event_type").isNotNull())
    return materialize(ev.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts"))
                       .agg(F.avg("value").alias("value")))


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals per priority on the full day grid, 0 where absent."""
    o = _table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    keyed = o.select(F.col("o_orderpriority").alias("series"),
                     F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts"),
                     nan_to_null("o_totalprice").alias("v"))
    b = keyed.select(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    grid = (keyed.select("series").distinct()
            .select("series", F.explode(F.sequence(b["lo"], b["hi"], F.expr("INTERVAL 1 DAY"))).alias("ts"))
            .withColumn("v", F.lit(0.0)))
    return materialize(keyed.unionByName(grid).groupBy("series", "ts")
                       .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value")))


def panel_daily_millions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel_daily`` in millions, so that squared errors keep their digits."""
    return panel_daily(spark, sf_dir).withColumn("value", F.col("value") / 1e6)


def test_panel(panel: DataFrame, history: int = 48, predict: int = 4) -> DataFrame:
    """Simulated test panel: blocks of ``history + predict`` hours, target values nulled.

    Only for the regular hour grid of ``panel_hourly``: the hour index from
    the first grid hour marks block members; a trailing partial block keeps
    its rows.  The job under test (``test_blocks``) computes its own
    positions and does not use this index.
    """
    size = history + predict
    b = panel.select(F.struct(F.min("ts").alias("lo"))).scalar()
    idx = F.floor((F.unix_seconds("ts") - F.unix_seconds(b["lo"])) / 3600)
    return materialize(panel.select("series", "ts", F.when(idx % size < history, F.col("value")).cast("double").alias("value")))
