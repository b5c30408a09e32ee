import datetime as dt

from hourglass.operators import joins
from hourglass.sources import panels as io


def test_write_scores_sorted_with_ties(spark, scratch):
    s = spark.createDataFrame([(3, 0.5), (1, 0.7), (2, 0.5)], "config_id long, mse double")
    io.write_scores(s.coalesce(1), f"{scratch}/s")
    back = spark.read.option("header", True).csv(f"{scratch}/s").collect()
    assert [int(r.config_id) for r in back] == [2, 3, 1]


def test_write_folds_layout(spark, scratch):
    df = spark.createDataFrame([(0, "train", 1.0), (0, "val", 2.0), (1, "train", 3.0)],
                               "fold int, fold_role string, v double")
    io.write_folds(df, f"{scratch}/f")
    back = spark.read.parquet(f"{scratch}/f/fold=0/fold_role=val").collect()
    assert [r.v for r in back] == [2.0]


def test_predictions_wide_timestamp_first(spark, scratch):
    base = dt.datetime(2024, 1, 1, 5)
    pred = spark.createDataFrame([("b", base, 1.0), ("a", base, 2.0)], "series string, ts timestamp, prediction double")
    io.write_predictions(pred, f"{scratch}/p", names=["a", "b"], single_file=True)
    back = spark.read.option("header", True).csv(f"{scratch}/p")
    assert back.columns == ["timestamp", "a", "b"]
    r = back.first()
    assert r.timestamp == "2024-01-01T05:00Z" and float(r.a) == 2.0


def test_read_panel_parquet_and_stations(spark, scratch):
    wide = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, float("nan"))], "timestamp timestamp, x double, y double")
    wide.write.parquet(f"{scratch}/w")
    long = io.read_panel(spark, f"{scratch}/w", fmt="parquet")
    got = {r.series: r.value for r in long.collect()}
    assert got == {"x": 1.0, "y": None}
    with open(f"{scratch}/st.csv", "w") as fh:
        fh.write("name,latitude,longitude\nP+R BARJE,46.0,14.5\n")
    st = io.read_stations(spark, f"{scratch}/st.csv").first()
    assert st.name == "P+R BARJE" and st.latitude == 46.0
    assert joins.param_grid(spark, {"l2": [1.0]}).count() == 1
