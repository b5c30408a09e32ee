"""Row positions in time order without a single-partition window.

A ``row_number()`` over a window with no ``PARTITION BY`` sends every row
to one task.  Here the time axis is cut into chunks (``chunk_seconds``, a
week by default, or with ``None`` an adaptive width of about a million rows);
rows are numbered inside their chunk (a window partitioned by chunk), the
chunk sizes are counted (one row per chunk), turned into running offsets,
and added back.  The per-chunk count table is the only thing ordered
globally and it has ``time span / chunk`` rows, not data-sized.

With ``keys`` (for instance ``["series"]``) positions restart per key, and
the chunk window is partitioned by ``(keys, chunk)``, so a hot series is
spread over all its chunks instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import materialize

# Regular panels (the data model): a week is 168 hourly rows per series and chunk.
# ``chunk_seconds=None`` picks an adaptive width for irregular timestamps at
# the price of one extra (min, max, count) pass over the input.
DEFAULT_CHUNK_SECONDS = 7 * 24 * 3600
TARGET_ROWS_PER_CHUNK = 1_000_000


def _chunk(df: DataFrame, ts: str, chunk_seconds: int | None):
    """Chunk id of each row.

    A fixed width when ``chunk_seconds`` is given.  Otherwise the width is
    a scalar subquery, ``time span * TARGET_ROWS_PER_CHUNK / rows``, so a chunk
    holds about that many rows on average whatever the time resolution
    (hourly panels or raw event timestamps).
    """
    us = F.unix_micros(F.col(ts))
    if chunk_seconds is not None:
        return F.floor(us / F.lit(chunk_seconds * 1_000_000))
    b = df.select(F.struct(F.min(us).alias("lo"), F.max(us).alias("hi"),
                           F.count(F.lit(1)).alias("n")).alias("b")).scalar()
    width = F.greatest(F.lit(1.0), (b["hi"] - b["lo"] + 1).cast("double")
                       * F.lit(float(TARGET_ROWS_PER_CHUNK)) / F.greatest(b["n"], F.lit(1)).cast("double"))
    return F.floor((us - b["lo"]) / width)


def number_rows(df: DataFrame, ts: str = "ts", keys: Sequence[str] = (), out: str = "pos",
                chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """0-based position of each row in ``ts`` order within ``keys``.

    Rows must be unique per ``(keys, ts)``; ties are broken by ``ts`` only.
    """
    keys = list(keys)
    c = df.withColumn("_chunk", _chunk(df, ts, chunk_seconds))
    local = c.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(ts)) - 1)
    counts = c.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    # Running offsets over the count table: one row per (keys, chunk).  Without
    # keys this window has no partition, deliberately: the table has one row
    # per chunk (520 for ten years of weeks), never the data rows themselves.
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, [*keys, "_chunk"])
            .withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_chunk", "_r", "_off"))


def number_rows_by_range(df: DataFrame, ts: str = "ts", keys: Sequence[str] = (), ties: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """``number_rows`` for any axis: 0-based position in the order of ``ts``, then ``ties``, within ``keys``.

    The rows are range-partitioned in this order with a row number as last
    column, so also rows that agree in everything are split, and written with
    their number in the partition.  A key's rows are contiguous there: its
    first number and its count per partition, summed over the partitions
    before, give every row's position without a window over rows.  However
    dense an hour is, it is spread over partitions.  Rows that agree in
    ``keys``, ``ts`` and ``ties`` are numbered in any order; nulls come first.
    """
    keys = list(keys)
    order = [*keys, ts, *ties, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    rows = materialize(rows.withColumn("_seq", F.monotonically_increasing_id()), "range-positions")
    rows = rows.withColumn("_part", F.shiftright("_seq", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per key and partition.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(parts, same).withColumn(out, F.col("_seq") + F.col("_shift")).select(*df.columns, out)


def positions(df: DataFrame, ts: str = "ts", out: str = "pos",
              chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Table ``(ts, pos)``: 0-based position of every DISTINCT timestamp."""
    d = df.select(ts).distinct()
    return number_rows(d, ts=ts, out=out, chunk_seconds=chunk_seconds)


def with_pos(df: DataFrame, ts: str = "ts", out: str = "pos",
             chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Add the position of each row's timestamp among the distinct timestamps (W1).

    This is the "row index after dropping incomplete rows" of a wide panel:
    in the long form every series shares the position of its timestamp.
    The position table has one row per timestamp; AQE broadcasts it when
    its measured size is small and otherwise sort-merge joins on ``ts``.
    """
    return df.join(positions(df, ts=ts, out=out, chunk_seconds=chunk_seconds), ts)


def count_positions(df: DataFrame, pos: str = "pos"):
    """Scalar-subquery column with the number of positions (max + 1)."""
    return df.select(F.coalesce(F.max(pos) + 1, F.lit(0)).cast("long")).scalar()
