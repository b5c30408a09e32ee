import datetime as dt
import math

from pyspark.sql import functions as F

from hourglass.functions.numeric import clip_floor
from hourglass.operators import joins, lags, panel
from hourglass.sources import panels as io
from tests.conftest import long_df

BASE = dt.datetime(2024, 1, 1)


def _df(spark, rows):
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def _holes(spark):
    return _df(spark, [("a", BASE + dt.timedelta(hours=h), float(h)) for h in (0, 1, 2, 4, 5, 6)])


def test_lag_join_nulls_at_holes(spark):
    out = {r.ts.hour: r for r in lags.lag_features(_holes(spark), [1, 2]).collect()}
    assert [h for h, r in sorted(out.items()) if r.value_lag1 is None] == [0, 4]
    assert [h for h, r in sorted(out.items()) if r.value_lag2 is None] == [0, 1, 5]
    assert out[6].value_lag1 == 5.0 and out[6].value_lag2 == 4.0


def test_lag_join_equals_self_join(spark):
    df = _holes(spark)
    a = df.alias("a")
    twin = (a.join(df.alias("b"), (F.col("a.series") == F.col("b.series"))
                   & (F.col("b.ts") + F.expr("INTERVAL 1 HOUR") == F.col("a.ts")), "left")
            .select(F.col("a.ts"), F.col("b.value").alias("v1")))
    want = {r.ts: r.v1 for r in twin.collect()}
    got = {r.ts: r.value_lag1 for r in lags.lag_features(df, [1]).collect()}
    assert got == want


def test_shift_rows_differs_over_holes(spark):
    out = {r.ts.hour: r for r in lags.shift_rows(_holes(spark), [1, 2]).collect()}
    assert out[4].prev_1_value == 2.0 and out[4].prev_2_value == 1.0
    assert out[0].prev_1_value is None


def test_continuity_mask_only_current_delta(spark):
    out = {r.ts.hour: r for r in lags.shift_continuous(_holes(spark), [1, 2], strict=False).collect()}
    assert out[4].prev_1_value is None          # delta 2 h: masked
    assert out[5].prev_1_value == 4.0 and out[5].prev_2_value == 2.0  # hole behind t-1 passes
    strict = {r.ts.hour: r for r in lags.shift_continuous(_holes(spark), [1, 2]).collect()}
    assert strict[5].prev_2_value is None


def test_nan_and_null_dropped(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, None), (3.0, 4.0)], "a double, b double")
    assert [r.a for r in panel.finite_mask(df, ["b"]).collect()] == [3.0]


def test_drop_incomplete_long(spark):
    rows = [("a", BASE, 1.0), ("b", BASE, 2.0), ("a", BASE + dt.timedelta(hours=1), 1.0),
            ("b", BASE + dt.timedelta(hours=1), None)]
    out = panel.drop_incomplete(_df(spark, rows))
    assert {r.ts for r in out.collect()} == {BASE}


def test_odd_names_round_trip(spark, scratch):
    names = ["CANKARJEVA UL.-NAMA", "P+R BARJE", "BTC CITY/DVORANA A"]
    rows = [(n, BASE + dt.timedelta(hours=h), float(i * 10 + h)) for i, n in enumerate(names) for h in range(3)]
    long = _df(spark, rows)
    wide = panel.to_wide(long, names)
    back = panel.to_long(wide, series=names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    io.write_panel(long, f"{scratch}/p", names)
    read = io.read_panel(spark, f"{scratch}/p")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, long.collect()))


def test_duplicate_ts_in_attributes_multiplies(spark):
    x = _df(spark, [("a", BASE, 1.0)])
    attrs = spark.createDataFrame([(BASE, 1), (BASE, 2)], "ts timestamp, k int")
    assert joins.with_attributes(x, attrs).count() == 2


def test_negative_predictions_clipped(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (None,)], "p double")
    assert [r.c for r in df.select(clip_floor("p").alias("c")).collect()] == [0.0, 0.0, 2.0, None]


def test_fill_from_and_unmatched(spark):
    p = _df(spark, [("a", BASE, 1.0), ("a", BASE + dt.timedelta(hours=1), None)])
    pred = spark.createDataFrame([("a", BASE + dt.timedelta(hours=1), 5.0), ("a", BASE + dt.timedelta(hours=9), 7.0)],
                                 "series string, ts timestamp, prediction double")
    got = sorted(r.value for r in joins.fill_from(p, pred).collect())
    assert got == [1.0, 5.0] and joins.unmatched(pred, p).count() == 1


def test_empty_input(spark):
    e = _df(spark, [])
    assert lags.lag_features(e, [1]).count() == 0
    assert panel.drop_incomplete(e).count() == 0


def test_missing_ts(spark):
    rows = [("a", BASE, None), ("b", BASE, None), ("a", BASE + dt.timedelta(hours=1), 1.0),
            ("b", BASE + dt.timedelta(hours=1), None)]
    assert [r.ts for r in panel.missing_ts(_df(spark, rows)).collect()] == [BASE]
    assert not math.isnan(1.0)


def test_duplicate_keys_are_an_error_and_not_lost(spark):
    import pytest
    p = long_df(spark, [("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 00:00", 2.0), ("a", "2024-01-01 01:00", 3.0)])
    with pytest.raises(Exception, match="more than one row"):
        lags.lag_features(p).collect()
