"""A stored layout of the panel that lags, windows, sequences and folds read without an exchange.

The time axis is cut into stretches of ``stretch_rows`` positions and the
rows are stored in buckets of (series, stretch).  Everything that needs
neighbouring rows of one series then happens inside one bucket:

- a window of a rule whose step divides ``stretch_rows`` never crosses a
  stretch, so sequences group by (series, stretch, window) where they lie;
- each stretch also holds, marked ``halo``, the rows of up to ``halo_seconds``
  before its first timestamp, so exact lags up to that reach are found in it;
- folds and splits are arithmetic on the window number.

Scale: writing shuffles the rows once (and the small axis table); all later
reads shuffle nothing but statistics, of which there is one row per series
and task.  The stretch is the salt: a series with a third of all rows lies
in as many groups as it has stretches, each of at most ``stretch_rows`` rows
and the halo.  The halo repeats ``halo / stretch`` of the rows, two of 4,928
for hourly lags of two.

The layout is a folder with ``rows`` (bucketed parquet), ``axis`` (timestamp,
position, stretch) and ``settings`` (one row), so that other sessions open it
by its path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourglass.operators.position import count_positions, positions
from hourglass.operators.scale import fit_scaler
from hourglass.operators.sequences import sequences
from hourglass.operators.windows import gap_windows

BUCKETED_BY = ("series", "stretch")


@dataclass(frozen=True)
class StoredPanel:
    """``rows`` (series, stretch, ts, pos, halo and the value columns), ``axis`` and the settings of a written layout."""
    rows: DataFrame
    axis: DataFrame
    stretch_rows: int
    halo_seconds: int

    @property
    def panel(self) -> DataFrame:
        """Every row once."""
        return self.rows.where(~F.col("halo")).drop("halo")


def stretch_rows_for(train: int, predict: int, gap: int, windows: int = 64) -> int:
    """Rows of a stretch that holds ``windows`` whole windows of the rule."""
    return windows * (train + predict + gap - 1)


def _axis(panel: DataFrame, stretch_rows: int, halo_seconds: int) -> DataFrame:
    """Distinct timestamps with pos, stretch and, where the row is also halo of the next stretch, ``next_stretch``."""
    at = positions(panel).withColumn("stretch", F.floor(F.col("pos") / F.lit(stretch_rows)).cast("long"))
    # One row per stretch, in order: the table is stretch_rows times smaller than the axis.
    order = Window.orderBy("stretch")
    starts = (at.groupBy("stretch").agg(F.min("ts").alias("start"))
              .select("stretch", F.lead("start").over(order).alias("next_start"), F.lead("start", 2).over(order).alias("after_next")))
    reach = F.make_dt_interval(secs=F.lit(halo_seconds))
    short = F.raise_error(F.lit("a stretch is shorter than the halo: take more rows per stretch or a shorter halo")).cast("boolean")
    into_next = (F.when(F.col("after_next") - reach < F.col("next_start"), short)
                 .otherwise(F.col("ts") >= F.col("next_start") - reach))
    return at.join(starts, "stretch").select("ts", "pos", "stretch", F.when(into_next, F.col("stretch") + 1).alias("next_stretch"))


def write_stored_panel(panel: DataFrame, path: str, stretch_rows: int, halo_seconds: int = 7200, buckets: int | None = None) -> StoredPanel:
    """Write ``panel`` (series, ts and value columns) as a layout below ``path``.

    Positions are those of the distinct timestamps of the panel.  Rows
    without series or timestamp have no place in a window and are left out;
    null values stay.  ``buckets`` (the shuffle partitions by default) is the
    number of files and later of tasks; size it so that one holds 128 to
    256 MB.  A stretch that lasts less than ``halo_seconds`` raises an error.
    An empty panel gives an empty layout.
    """
    spark = panel.sparkSession
    if stretch_rows < 1 or halo_seconds < 0:
        raise ValueError("need stretch_rows >= 1 and halo_seconds >= 0")
    clash = {"stretch", "pos", "halo", "next_stretch"} & {c.lower() for c in panel.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the layout's own; rename them first")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = panel.where(F.col("series").isNotNull() & F.col("ts").isNotNull())
    _axis(rows, stretch_rows, halo_seconds).write.parquet(f"{path}/axis")
    axis = spark.read.parquet(f"{path}/axis")

    def places(stretch: Column, halo: bool) -> Column:
        return F.struct(stretch.alias("stretch"), F.lit(halo).alias("halo"))

    held = F.explode(F.filter(F.array(places(F.col("stretch"), False), places(F.col("next_stretch"), True)), lambda p: p["stretch"].isNotNull()))
    placed = rows.join(axis, "ts").withColumn("_held", held).select(*panel.columns, "pos", "_held.stretch", "_held.halo")
    name = _table_name()
    (placed.repartition(buckets, *BUCKETED_BY).write.bucketBy(buckets, *BUCKETED_BY).sortBy(*BUCKETED_BY, "ts")
     .format("parquet").option("path", f"{path}/rows").saveAsTable(name))
    settings = spark.range(1).select(F.lit(stretch_rows).alias("stretch_rows"), F.lit(halo_seconds).alias("halo_seconds"), F.lit(buckets).alias("buckets"))
    settings.write.parquet(f"{path}/settings")  # last: a folder with settings is a whole layout
    return StoredPanel(spark.table(name), axis, stretch_rows, halo_seconds)


def open_stored_panel(spark: SparkSession, path: str) -> StoredPanel:
    """A layout written before, also by another session."""
    settings = spark.read.parquet(f"{path}/settings").first()
    columns = spark.read.parquet(f"{path}/rows").schema
    name, by = _table_name(), ", ".join(BUCKETED_BY)
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}, ts) INTO {settings.buckets} BUCKETS LOCATION '{place}/rows'")
    return StoredPanel(spark.table(name), spark.read.parquet(f"{path}/axis"), settings.stretch_rows, settings.halo_seconds)


def _table_name() -> str:
    return f"hourglass_panel_{uuid.uuid4().hex[:12]}"


def stored_lags(stored: StoredPanel, lags: Sequence[int] = (1, 2), unit_seconds: int = 3600, value: str = "value", suffix: str = "_lag{n}") -> DataFrame:
    """``lag_features`` of the stored rows: value at exactly ``ts - n * unit``, NULL where that time is absent.

    No exchange: every partner is in the row's stretch or its halo.  A lag
    beyond the halo is refused.  Two rows of one series and time raise an
    error when the plan runs.
    """
    if not lags or min(lags) < 1 or max(lags) * unit_seconds > stored.halo_seconds:
        raise ValueError(f"lags must be 1 or more and reach back at most {stored.halo_seconds} seconds")
    at = Window.partitionBy(*BUCKETED_BY).orderBy("_us")
    twice = F.raise_error(F.lit("more than one row with the same series, ts")).cast("boolean")
    unit = unit_seconds * 1_000_000
    names = {n: f"{value}{suffix.format(n=n)}" for n in lags}
    found = stored.rows.withColumn("_us", F.unix_micros("ts")).withColumns({
        "_same": F.count(F.lit(1)).over(at.rangeBetween(0, 0)),
        **{name: F.max(value).over(at.rangeBetween(-n * unit, -n * unit)) for n, name in names.items()}})
    once = F.when(F.col("_same") > 1, twice).otherwise(~F.col("halo"))
    kept = [c for c in stored.rows.columns if c not in ("stretch", "pos", "halo")]
    return found.where(once).select(*kept, *names.values())


def stored_windows(stored: StoredPanel, train: int = 48, predict: int = 4, gap: int = 26) -> DataFrame:
    """``gap_windows`` of the stored rows, which keep ``stretch``; no exchange.

    The step ``train + predict + gap - 1`` must divide the stretch.
    """
    step = train + predict + gap - 1
    if stored.stretch_rows % step:
        raise ValueError(f"windows every {step} rows cross the borders of stretches of {stored.stretch_rows} rows")
    return gap_windows(stored.panel, train, predict, gap, n=count_positions(stored.axis))


def stored_sequences(stored: StoredPanel, train: int = 48, predict: int = 4, gap: int = 26, value: str = "value") -> DataFrame:
    """Scaled sequences (series, stretch, window_id, x, y) with the statistics of the input rows.

    Windows are gathered inside their bucket and scaled as arrays.  Only the
    statistics move: each series' row is repeated per stretch, so their join
    uses the stored partitioning and splits a hot series.
    """
    w = stored_windows(stored, train, predict, gap)
    gathered = sequences(w, x_col=value, y_col=value, keys=BUCKETED_BY, train=train, predict=predict)
    stats = fit_scaler(w, value=value, where=F.col("role") == "x").select("series", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    last = stored.axis.select(F.max("stretch")).scalar()
    per_stretch = stats.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    scaled = F.transform("x", lambda v: (v - F.col("_mean")) / F.col("_std"))
    return gathered.join(per_stretch, list(BUCKETED_BY), "left").withColumn("x", scaled).drop("_mean", "_std")
