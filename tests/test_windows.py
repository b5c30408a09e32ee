import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourglass.operators import position, windows


def _loop_windows(n, train, predict, gap):
    """Brute-force twin of the window rule: slices of a row list."""
    total = train + predict + gap
    step = total - 1
    out = []
    for wid, idx in enumerate(range(0, n - total, step)):
        out += [(idx + o, wid, "x") for o in range(train)]
        out += [(idx + train + o, wid, "y") for o in range(predict)]
    return out


def _hours(spark, n, holes=()):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(hours=i), float(i)) for i in range(n) if i not in holes]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double") if rows else \
        spark.createDataFrame([], "series string, ts timestamp, value double")


@pytest.mark.parametrize("n,expected", [(0, 0), (77, 0), (78, 0), (79, 1), (155, 1), (156, 2)])
def test_window_counts(spark, n, expected):
    w = windows.gap_windows(_hours(spark, n), 48, 4, 26)
    assert w.select("window_id").distinct().count() == expected


@pytest.mark.parametrize("n", [79, 160, 250])
def test_windows_equal_loop(spark, n):
    w = windows.gap_windows(_hours(spark, n), 48, 4, 26)
    got = sorted((r.pos, r.window_id, r.role) for r in w.collect())
    assert got == sorted(_loop_windows(n, 48, 4, 26))


def test_x_and_y_never_overlap(spark):
    w = windows.gap_windows(_hours(spark, 400), 24, 4, 5)
    x = {r.pos for r in w.where("role = 'x'").collect()}
    y = {r.pos for r in w.where("role = 'y'").collect()}
    assert x and y and not (x & y)


def test_positions_small_chunks_match_rank(spark):
    df = _hours(spark, 300, holes={5, 6, 100, 299})
    got = [r.pos for r in position.with_pos(df, chunk_seconds=7200).orderBy("ts").collect()]
    assert got == list(range(len(got)))


def test_positions_per_series(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(s, base + dt.timedelta(hours=i), 1.0) for s in "ab" for i in range(0, 50, 1 if s == "a" else 3)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    out = position.number_rows(df, keys=["series"], chunk_seconds=3600 * 5)
    for s in "ab":
        got = [r.pos for r in out.where(F.col("series") == s).orderBy("ts").collect()]
        assert got == list(range(len(got)))


def test_folds_disjoint_and_blocks(spark):
    w = windows.gap_windows(_hours(spark, 720), 24, 4, 5)
    f = windows.blocked_folds(w, k=4, train_share=0.8)
    wins = f.select("fold", "fold_role", "window_id").distinct().collect()
    by_fold = {}
    for r in wins:
        by_fold.setdefault(r.fold, set()).add(r.window_id)
    all_w = [x for s in by_fold.values() for x in s]
    n = w.select("window_id").distinct().count()
    assert len(all_w) == len(set(all_w)) == n == 22  # every window is in one fold
    assert sorted(map(len, by_fold.values())) == [5, 5, 6, 6]
    assert all({r.fold_role for r in wins if r.fold == k} == {"train", "val"} for k in range(4))
    assert all(max(by_fold[k]) + 1 == min(by_fold[k + 1]) for k in range(3))


def test_too_few_windows_for_the_folds_is_an_error(spark):
    w = windows.gap_windows(_hours(spark, 240), 24, 4, 5)
    with pytest.raises(Exception, match="need at least 40 windows"):
        windows.blocked_folds(w, k=20).collect()


def test_test_blocks_and_targets(spark):
    df = _hours(spark, 104)
    b = windows.test_blocks(df)
    t = windows.target_timestamps(b).collect()
    assert len(t) == 8 and {r.horizon for r in t} == {0, 1, 2, 3}


def test_hashed_folds_stable_under_repartition(spark):
    df = _hours(spark, 200)
    a = {r.ts: r.fold for r in windows.hashed_folds(df).collect()}
    b = {r.ts: r.fold for r in windows.hashed_folds(df.repartition(7)).collect()}
    assert a == b and set(a.values()) <= set(range(5))
