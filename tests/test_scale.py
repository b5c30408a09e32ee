"""Hot-key behaviour: one series holds a third of all rows."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from hourglass.operators import lags, position

BASE = dt.datetime(2024, 1, 1)


def _hot_panel(spark):
    rows = [("hot", BASE + dt.timedelta(hours=h), float(h % 17)) for h in range(3000)]
    for s in range(60):
        rows += [(f"s{s:02d}", BASE + dt.timedelta(hours=h), float((h * (s + 1)) % 11)) for h in range(100)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(8)


def test_lag_shuffle_spreads_hot_series(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lags.lag_features(_hot_panel(spark), [1, 2])
        sizes = out.where(F.col("series") == "hot").rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 3000
    # hashed on (series, ts): the hot series lands in every partition, none holds most of it
    assert max(sizes) < 0.5 * sum(sizes) and sum(1 for s in sizes if s > 0) == len(sizes)


def test_hot_series_lags_and_positions_exact(spark):
    df = _hot_panel(spark)
    pdf = df.toPandas().sort_values(["series", "ts"])
    pdf["lag1"] = pdf.groupby("series")["value"].shift(1)
    got = lags.lag_features(df, [1]).toPandas().sort_values(["series", "ts"])
    assert got["value_lag1"].fillna(-1).tolist() == pdf["lag1"].fillna(-1).tolist()
    pos = position.number_rows(df, keys=["series"], chunk_seconds=24 * 3600).toPandas()
    pos = pos.sort_values(["series", "ts"])
    want = pos.groupby("series").cumcount()
    assert pos["pos"].tolist() == want.tolist()


def test_number_rows_hot_chunks_bounded(spark):
    # With keys, the numbering window is partitioned by (series, chunk): a day per group here.
    df = _hot_panel(spark).withColumn("_chunk", F.floor(F.unix_micros("ts") / F.lit(24 * 3600 * 1_000_000)))
    biggest = df.groupBy("series", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 24
    assert isinstance(pd.Timestamp(BASE), pd.Timestamp)


def test_adaptive_chunks_exact(spark):
    df = _hot_panel(spark)
    pos = position.number_rows(df, keys=["series"], chunk_seconds=None).toPandas().sort_values(["series", "ts"])
    assert pos["pos"].tolist() == pos.groupby("series").cumcount().tolist()


def test_hot_series_is_spread_over_the_scaler_join_and_the_sequences(spark):
    from hourglass.operators import scale, sequences, windows
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = _hot_panel(spark)
        scaled = scale.apply_scaler(df, scale.fit_scaler(df))
        sizes = scaled.where(F.col("series") == "hot").rdd.glom().map(len).collect()
        assert sum(sizes) == 3000 and max(sizes) < 0.5 * sum(sizes)
        w = windows.gap_windows(df, 24, 4, 5)
        seq = sequences.sequences(scale.apply_scaler(w, scale.fit_scaler(w, where=F.col("role") == "x")), train=24, predict=4)
        sizes = seq.where(F.col("series") == "hot").rdd.glom().map(len).collect()
        assert max(sizes) < 0.5 * sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _largest_broadcast(spark, df):
    """Rows of the largest relation that the executed plan of ``df`` broadcasts."""
    df.collect()
    plan, largest = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        n = nodes.pop()
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(n.executedPlan())
            continue
        if name in ("BroadcastQueryStage", "ShuffleQueryStage"):
            nodes.append(n.plan())
            continue
        if name == "BroadcastExchange":
            largest = max(largest, n.metrics().apply("numOutputRows").value())
        children = n.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return largest


def _users(spark, n, hours, value=0.0):
    """A panel that parquet compresses to almost nothing."""
    from hourglass.session import materialize
    return materialize(spark.range(n * hours).select(
        F.format_string("u%05d", F.floor(F.col("id") / hours).cast("int")).alias("series"),
        (F.lit(BASE) + F.make_interval(hours=(F.col("id") % hours).cast("int"))).cast("timestamp").alias("ts"),
        F.when(F.col("id") % 24 == 0, F.lit(1.0)).otherwise(F.lit(value)).alias("value")))


def test_a_well_compressed_panel_is_not_broadcast_for_its_positions(spark):
    from hourglass.operators import windows
    w = windows.gap_windows(_users(spark, 400, 120), 24, 4, 5)
    assert _largest_broadcast(spark, w.where("offset = 0")) <= 120


def test_models_of_many_short_series_are_neither_broadcast_nor_repeated(spark):
    from hourglass.plans import lagmodels
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        p = _users(spark, 600, 200)
        model, stats = lagmodels.fit_lags(p, "lags", 24, 4, 5)
        pred = lagmodels.predict_blocks(p, model, stats, "lags", 24, 4)
        assert _largest_broadcast(spark, pred) <= 200
        assert pred.count() == 600 * 4 * 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_pass_models_equal_summed_statistics(spark):
    from hourglass.plans import direct
    rows = [(s, w, [float((w * 7 + s * 3) % 5), float((w * w + s) % 7)], [float((w + s) % 3)]) for s in range(5) for w in range(12)]
    df = spark.createDataFrame(rows, "series int, window_id long, f array<double>, y array<double>").repartition(4)
    a = direct.fit_direct(df, ["series"], 2, 1, window="window_id").orderBy("series").collect()
    b = direct.fit_direct(df, ["series"], 2, 1, window="window_id", windows=12).orderBy("series").collect()
    assert len(a) == len(b) == 5
    for x, y in zip(a, b, strict=True):
        assert x.n == y.n == 12 and abs(x.intercept - y.intercept) < 1e-9
        assert max(abs(i - j) for i, j in zip(x.coef, y.coef, strict=True)) < 1e-9
    known = direct.predict_direct(df, direct.fit_direct(df, ["series"], 2, 1), ["series"], windows=12).collect()
    assert sorted(known) == sorted(direct.predict_direct(df, direct.fit_direct(df, ["series"], 2, 1), ["series"]).collect()) and len(known) == 60


def _shuffle_rows(spark, df):
    """Rows that the exchanges of the executed plan of ``df`` write."""
    df.collect()
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        n = nodes.pop()
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(n.executedPlan())
            continue
        if name.endswith("QueryStage"):
            nodes.append(n.plan())
            continue
        if name == "Exchange":
            total += n.metrics().apply("shuffleRecordsWritten").value()
        children = n.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_lags_shuffle_each_row_about_once(spark):
    df = _hot_panel(spark)
    lagged = lags.lag_features(df, [1, 2])
    repartitioned = 9000
    assert df.count() == 9000 and _shuffle_rows(spark, lagged) - repartitioned < 1.1 * 9000


def test_time_lags_equal_the_gathered_ones(spark):
    """Times between the hours, holes, null times, null series, null values."""
    rows = [(None if i % 97 == 0 else f"s{i % 7}", None if 350 <= i < 353 else BASE + dt.timedelta(minutes=30 * (i // 7), microseconds=i % 3),
             None if i % 11 == 0 else i * 1.5, i) for i in range(1500) if i % 13]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double, extra long").dropDuplicates(["series", "ts"]).localCheckpoint()
    for n in ([1, 2], [1], [3, 5], [60]):
        want = lags.gather_shifted(df, ["series"], "ts", {"value": {k: f"value_lag{k}" for k in n}}, lambda c, k: c + F.make_dt_interval(secs=F.lit(k * 3600)))
        got = lags.lag_features(df, n)
        order = lambda r: tuple((v is not None, v) for v in r)
        assert got.columns == want.columns and sorted(map(order, got.collect())) == sorted(map(order, want.collect()))
