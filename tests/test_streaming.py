import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import windows


def events(spark, tmp_path, n=200):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=(i * 37) % 3000), i % 5, f"t{i % 3}", float(i), "{}") for i in range(n)]
    df = spark.createDataFrame(rows, windows.EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), windows.event_stream(spark, str(tmp_path / "in"))


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_window_counts_equal_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    for name, args in (("tumbling", ("1 hour",)), ("sliding", ("1 hour", "30 minutes"))):
        got = drain(spark, windows.window_counts(stream, *args), name, tmp_path, "complete")
        assert sorted(got.collect()) == sorted(windows.window_counts(batch, *args).collect())


def test_sessions_equal_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = drain(spark, windows.session_counts(stream, "30 minutes"), "sessions", tmp_path, "complete")
    assert sorted(got.collect()) == sorted(windows.session_counts(batch, "30 minutes").collect())


def test_open_spans_close_as_in_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = {(r.user_id, r.start, r.end, r.n) for r in drain(spark, windows.open_spans(stream, 1800.0), "spans", tmp_path).collect()}
    want = {(r.user_id, r.start.timestamp(), (r.end - dt.timedelta(minutes=30)).timestamp(), r.n) for r in windows.session_counts(batch, "30 minutes").collect()}
    assert got <= {(u, a, b, n) for u, a, b, n in want} and len(got) >= len(want) - 5
