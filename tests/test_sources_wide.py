import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hourglass.operators import position
from hourglass.sources import panels as io


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as fh:
        fh.write(text)


def cells(df):
    return sorted((r.series, r.ts.strftime("%dT%H"), r.value) for r in df.collect())


def test_files_with_different_headers_are_read_by_their_own(spark, scratch):
    d = f"{scratch}/mixed"
    put(d, "a.csv", 'timestamp,A,"B, ""x"""\n2024-01-01T00:00Z,1.5,2\n2024-01-01T01:00Z,,NaN\n')
    put(d, "b.csv", '"B, ""x""",timestamp,C\n7,2024-01-02T00:00Z,8\n\n')
    put(d, "c.csv", "timestamp,A\n")
    assert cells(io.read_panel(spark, d)) == [("A", "01T00", 1.5), ("A", "01T01", None), ('B, "x"', "01T00", 2.0), ('B, "x"', "01T01", None),
                                              ('B, "x"', "02T00", 7.0), ("C", "02T00", 8.0)]
    assert {r.series for r in io.panel_series(spark, d).collect()} == {"A", 'B, "x"', "C"}
    with pytest.raises(ValueError):
        io.read_panel(spark, d, long=False)


def test_lines_that_do_not_fit_are_counted(spark, scratch):
    d = f"{scratch}/bad"
    put(d, "a.csv", "timestamp,A,B\n2024-01-01T00:00Z,1,2\n2024-01-01T01:00Z,1\nyesterday,1,2\n2024-01-01T02:00Z,one,2\n2024-01-01T03:00Z,1,2,3\n")
    put(d, "b.csv", "timestamp,A\n2024-01-03T00:00Z,4\n")
    got = {os.path.basename(r.file): (r["rows"], r.bad_rows) for r in io.line_report(spark, d).collect()}
    assert got == {"a.csv": (5, 4), "b.csv": (1, 0)}
    assert cells(io.read_panel(spark, d, bad_lines="drop")) == [("A", "01T00", 1.0), ("A", "03T00", 4.0), ("B", "01T00", 2.0)]
    with pytest.raises(PySparkException):
        io.read_panel(spark, d).collect()
    put(f"{scratch}/none", "a.csv", "2024-01-01T00:00Z,1,2\n")
    with pytest.raises(PySparkException):
        io.read_panel(spark, f"{scratch}/none").collect()


def test_twenty_thousand_series_in_column_groups(spark, scratch):
    n, base = 20_000, dt.datetime(2024, 1, 1)
    ids = spark.range(n * 3).select(F.concat(F.lit('S "'), (F.col("id") % n).cast("string"), F.lit('", x')).alias("series"),
                                    (F.lit(base) + F.make_interval(hours=F.floor(F.col("id") / n).cast("int"))).cast("timestamp").alias("ts"),
                                    F.when(F.col("id") % 7 != 0, F.col("id") / 7).alias("value"))
    io.write_panel_groups(ids, f"{scratch}/groups")
    back = io.read_panel_groups(spark, f"{scratch}/groups")
    assert len(os.listdir(f"{scratch}/groups/rows")) >= 40 and back.count() == 3 * n
    assert back.exceptAll(ids).count() == 0
    header = spark.read.text(f"{scratch}/groups/header/group=0").first().value
    assert header.startswith("timestamp,") and len(header.split('","')) == io.GROUP_SERIES


def test_range_positions_equal_row_numbers_and_spread_a_dense_hour(spark):
    """A third of all rows lies in one hour, many of them equal; nulls are a key of their own."""
    base = dt.datetime(2024, 1, 1)
    rows = [(["a", "b", None][i % 3], base + dt.timedelta(hours=i), i) for i in range(600)]
    rows += [("a", base + dt.timedelta(hours=50, microseconds=i // 2), -(i // 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, tie int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = position.number_rows_by_range(df, "ts", ["series"], ["tie"]).collect()
        plain = position.number_rows_by_range(df, "ts").withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        of = sorted((r for r in got if r.series == s), key=lambda r: r.pos)
        assert [r.pos for r in of] == list(range(len(of)))
        assert [(r.ts, r.tie) for r in of] == sorted((t, i) for k, t, i in rows if k == s)
    assert sorted(r.pos for r in plain) == list(range(len(rows)))
    dense = [r for r in plain if base + dt.timedelta(hours=50) <= r.ts < base + dt.timedelta(hours=51)]
    assert len(dense) >= 300 and len({r.p for r in dense}) > 1
    assert position.number_rows_by_range(df.limit(0), "ts", ["series"]).count() == 0


def test_group_lines_with_holes_null_values_and_a_series_twice(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"s{k:02d}", base + dt.timedelta(hours=h), None if (k + h) % 5 == 0 else k + h / 10) for k in range(7) for h in range(60 * 24) if (k, h) != (3, 5)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    io.write_panel_groups(df, f"{scratch}/holes", width=3)
    got = {(r.series, r.ts): r.value for r in io.read_panel_groups(spark, f"{scratch}/holes").collect()}
    assert got == {(s, t): v for s, t, v in rows} | {("s03", base + dt.timedelta(hours=5)): None}
    for file in os.listdir(f"{scratch}/holes/rows/group=0"):
        if file.startswith("part-"):
            lines = open(f"{scratch}/holes/rows/group=0/{file}").read().split()
            assert lines == sorted(lines)
    with pytest.raises(PySparkException):
        io.write_panel_groups(df.unionByName(df.limit(1)).where("series != 's01' or ts > '2024-01-02'"), f"{scratch}/twice", width=3)


def test_group_cells_are_not_broadcast_and_dealt_once(spark, scratch, monkeypatch):
    """The lines of a group and month come from one task: a file each, without a range partition that gathers them a second time."""
    base = dt.datetime(2024, 1, 1)
    df = spark.range(4 * 300).select(F.format_string("s%d", F.col("id") % 4).alias("series"),
                                     (F.lit(base) + F.make_interval(hours=F.floor(F.col("id") / 4).cast("int"))).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))
    ranged = []
    plain = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *a: ranged.append(self.columns) or plain(self, *a))
    io.write_panel_groups(df, f"{scratch}/once", width=2)
    assert all("ts" not in c for c in ranged)
    assert io.read_panel_groups(spark, f"{scratch}/once").exceptAll(df.select("series", "ts", "value")).count() == 0
