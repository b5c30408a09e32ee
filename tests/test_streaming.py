import datetime as dt

from hourglass.streaming import featurize, start_featurizer


def test_featurize_stream_matches_batch(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(hours=h), float(h)) for h in range(30)]
    src = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    src.write.parquet(f"{scratch}/in")
    stats = spark.createDataFrame([("a", 10.0, 2.0)], "series string, mean double, std double")
    stream = spark.readStream.schema(src.schema).parquet(f"{scratch}/in")
    assert stream.isStreaming
    q = start_featurizer(stream, stats, f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{scratch}/out")
    want = featurize(src, stats)
    assert got.count() == 30
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
