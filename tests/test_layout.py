import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hourglass.operators import lags, scale, sequences, windows
from hourglass.sources import layout

START = dt.datetime(2024, 1, 1)
RULE = (6, 2, 3)  # a window every 10 rows
STEP = 10


def hours(n, k):
    return START + dt.timedelta(hours=n, minutes=k)


@pytest.fixture(scope="module")
def panel(spark):
    """A hot series with a row every hour, two short ones with holes, nulls."""
    rows = [("hot", hours(h, 0), float(h * h % 97)) for h in range(600)]
    rows += [("b", hours(h, 0), None if h % 11 == 0 else float(h % 7)) for h in range(0, 600, 3)]
    rows += [("c", hours(h, 0), float(h)) for h in range(100, 130)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


@pytest.fixture(scope="module")
def stored(spark, panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "p")
    layout.write_stored_panel(panel, path, stretch_rows=2 * STEP, buckets=4)
    return layout.open_stored_panel(spark, path)


def exchanges(df):
    """Numbers of exchanges in the plan itself and in its scalar subqueries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    main = re.split(r"\n?Subquery", plan)[0]
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", main))


def table(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lags_equal_the_operator_without_an_exchange(panel, stored):
    columns = ["series", "ts", "value", "value_lag1", "value_lag2"]
    got, want = layout.stored_lags(stored), lags.lag_features(panel)
    assert table(got, columns) == table(want, columns)
    assert exchanges(got) == 0 < exchanges(want)


def test_windows_and_sequences_stay_in_their_buckets(panel, stored):
    columns = ["series", "ts", "value", "pos", "window_id", "offset", "role"]
    w = windows.gap_windows(panel, *RULE)
    got = layout.stored_windows(stored, *RULE)
    assert table(got, columns) == table(w, columns) and exchanges(got) == 0
    plain = sequences.sequences(got, "value", "value", layout.BUCKETED_BY, train=6, predict=2)
    assert exchanges(plain) == 0


def test_scaled_sequences_move_statistics_only(spark, panel, stored):
    w = windows.gap_windows(panel, *RULE)
    scaled = scale.apply_scaler(w, scale.fit_scaler(w, where=F.col("role") == "x"))
    want = sequences.sequences(scaled, train=6, predict=2)
    got = layout.stored_sequences(stored, *RULE)
    rounded = [F.transform("x", lambda v: F.round(v, 9)).alias("x"), "y"]
    assert table(got, ["series", "window_id", *rounded]) == table(want, ["series", "window_id", *rounded])
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # also as a sort-merge join the windows stay where they are
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = layout.stored_sequences(stored, *RULE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = lines[join].index("+-") + 3
    first, second = [i for i in range(join + 1, len(lines)) if lines[i][depth:depth + 3] in (":- ", "+- ")][:2]
    left = "".join(lines[first:second])
    assert "Bucketed: true" in left and "Exchange hashpartitioning" not in left


def test_a_hot_series_lies_in_many_groups(stored):
    groups = stored.rows.where("series = 'hot'").groupBy("stretch").count().collect()
    assert len(groups) == 30 and max(r["count"] for r in groups) <= 2 * STEP + 2


def test_fold_numbers_need_no_exchange(panel, stored):
    columns = ["series", "ts", "window_id", "role", "fold", "fold_role"]
    got = windows.blocked_folds(layout.stored_windows(stored, *RULE), k=3)
    assert table(got, columns) == table(windows.blocked_folds(windows.gap_windows(panel, *RULE), k=3), columns)
    assert exchanges(got) == 0


def test_refused_uses(spark, panel, stored, scratch):
    with pytest.raises(ValueError, match="at most 7200 seconds"):
        layout.stored_lags(stored, [3])
    with pytest.raises(ValueError, match="cross the borders"):
        layout.stored_windows(stored, 6, 2, 4)
    with pytest.raises(ValueError, match="rename"):
        layout.write_stored_panel(panel.withColumn("Stretch", F.lit(1)), f"{scratch}/a", 20)
    with pytest.raises(Exception, match="shorter than the halo"):
        layout.write_stored_panel(panel, f"{scratch}/b", 20, halo_seconds=86400)
    twice = panel.where("series = 'c'")
    with pytest.raises(Exception, match="more than one row"):
        layout.stored_lags(layout.write_stored_panel(twice.unionByName(twice), f"{scratch}/c", 20)).count()


def test_empty_null_and_extra_columns(spark, panel, scratch):
    empty = layout.write_stored_panel(panel.where("false"), f"{scratch}/empty", 20)
    assert layout.stored_lags(empty).count() == layout.stored_sequences(empty, *RULE).count() == 0
    odd = spark.createDataFrame([(None, hours(1, 0), 1.0, "x"), ("a", None, 2.0, "y"), ("a", hours(1, 0), None, "it's"), ("a", hours(2, 0), 4.0, None)],
                                "series string, ts timestamp, value double, `odd name` string")
    layout.write_stored_panel(odd, f"{scratch}/it's odd", 20)
    got = layout.stored_lags(layout.open_stored_panel(spark, f"{scratch}/it's odd"), [1])
    assert table(got, ["series", "ts", "value", "odd name", "value_lag1"]) == table(
        odd.where("series is not null and ts is not null").withColumn("value_lag1", F.lit(None)), ["series", "ts", "value", "odd name", "value_lag1"])
