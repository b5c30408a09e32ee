"""Training windows, test blocks, splits and folds: arithmetic on positions.

After ``with_pos`` every rule here is a projection/filter on ``pos`` (no
shuffle of its own); counts such as the number of rows ``N`` enter as
scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.operators.position import count_positions, positions
from hourglass.session import materialize


def _ensure_pos(df: DataFrame, pos: str, ts: str):
    """``(df with pos, N)``; N is a scalar subquery over the distinct-timestamp table only.

    The table is written, so the join sees its real size: estimated from its
    plan it is larger than a well compressed panel, which would be broadcast.
    """
    if pos in df.columns:
        return df, count_positions(df, pos)
    tbl = materialize(positions(df, ts=ts, out=pos), "positions")
    return df.join(tbl, ts), count_positions(tbl, pos)


def gap_windows(df: DataFrame, train: int = 48, predict: int = 4, gap: int = 26,
                ts: str = "ts", pos: str = "pos", keep_gap: bool = False, n: Column | None = None) -> DataFrame:
    """Non-overlapping windows: ``train`` input rows, ``predict`` target rows, then a gap.

    A window starts at positions ``0, step, 2*step, ...`` with
    ``step = train + predict + gap - 1`` while ``start < N - (train + predict + gap)``
    (strict), so the effective gap is ``gap - 1`` rows and a last window that
    would just fit is dropped.  Adds ``window_id``, ``offset`` and ``role``
    (``'x'`` input, ``'y'`` target, ``'gap'`` only with ``keep_gap``).  ``n`` is
    the number of positions where ``df`` has ``pos`` and the caller knows it.
    """
    if min(train, predict) < 1 or gap < 1:
        raise ValueError("train, predict and gap must be positive")
    if n is None:
        df, n = _ensure_pos(df, pos, ts)
    step = train + predict + gap - 1
    total = train + predict + gap
    wid = F.floor(F.col(pos) / F.lit(step)).cast("long")
    off = (F.col(pos) % F.lit(step)).cast("int")
    role = (F.when(off < train, F.lit("x"))
            .when(off < train + predict, F.lit("y"))
            .otherwise(F.lit("gap")))
    out = (df.withColumns({"window_id": wid, "offset": off, "role": role})
           .where(F.col("window_id") * F.lit(step) < n - F.lit(total)))
    return out if keep_gap else out.where(F.col("role") != "gap")


def test_blocks(df: DataFrame, history: int = 48, predict: int = 4, ts: str = "ts",
                pos: str = "pos") -> DataFrame:
    """Consecutive blocks of ``history + predict`` rows: ``block_id``, ``block_offset``, ``role``."""
    df, _ = _ensure_pos(df, pos, ts)
    size = history + predict
    off = (F.col(pos) % F.lit(size)).cast("int")
    return df.withColumns({
        "block_id": F.floor(F.col(pos) / F.lit(size)).cast("long"),
        "block_offset": off,
        "role": F.when(off < history, F.lit("x")).otherwise(F.lit("y")),
    })


def target_timestamps(blocks: DataFrame, history: int = 48) -> DataFrame:
    """The target rows of each block, with their horizon (0-based)."""
    return (blocks.where(F.col("block_offset") >= history)
            .withColumn("horizon", (F.col("block_offset") - F.lit(history)).cast("int")))


def split_windows(w: DataFrame, frac: float = 0.8, window: str = "window_id") -> DataFrame:
    """Chronological split by window: the first ``floor(n * frac)`` windows train, the rest val."""
    n = w.select(F.count_distinct(window)).scalar()
    cut = F.floor(n * F.lit(frac))
    return w.withColumn("split", F.when(F.col(window) < cut, F.lit("train")).otherwise(F.lit("val")))


def split_rows(df: DataFrame, frac: float = 0.8, pos: str = "pos", ts: str = "ts") -> DataFrame:
    """Chronological split by row position: the first ``floor(N * frac)`` rows train."""
    df, n = _ensure_pos(df, pos, ts)
    cut = F.floor(n * F.lit(frac))
    return df.withColumn("split", F.when(F.col(pos) < cut, F.lit("train")).otherwise(F.lit("val")))


def blocked_folds(w: DataFrame, k: int = 5, train_share: float = 0.8, window: str = "window_id") -> DataFrame:
    """``k`` contiguous blocks over all windows; the first ``train_share`` of each block's windows train, the rest val.

    Block sizes follow the window count (they differ by one at most), and
    every block has at least one window of each role; fewer than two windows
    per block raise an error when the plan runs.
    """
    if not 0 < train_share < 1 or k < 1:
        raise ValueError("need k >= 1 and 0 < train_share < 1")
    n = w.select(F.max(window) + 1).scalar().cast("long")
    number = F.col(window).cast("long")
    too_few = F.raise_error(F.lit(f"blocked_folds: {k} folds need at least {2 * k} windows")).cast("long")
    fold = F.when(n >= 2 * k, F.floor(number * k / n)).otherwise(too_few)
    first = F.ceil(F.col("fold") * n / k)
    size = F.ceil((F.col("fold") + 1) * n / k) - first
    train = F.greatest(F.lit(1), F.least(size - 1, F.floor(size * F.lit(train_share))))
    return (w.withColumn("fold", fold.cast("int"))
            .withColumn("fold_role", F.when(number - first < train, F.lit("train")).otherwise(F.lit("val"))))


def hashed_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "ts") -> DataFrame:
    """Random-looking k-fold assignment that is stable under repartitioning and retries.

    The first eight hexadecimal digits of the MD5 of ``key|seed``, modulo ``k``.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))
