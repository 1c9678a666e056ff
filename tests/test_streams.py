import datetime as dt
import time

from pyspark.sql import functions as F

from feedloom.operators import merges, sessions
from feedloom.streaming import streams


def test_sessions_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in streams.session_counts(batch, "user_id", "ts", "6 hours").collect()}
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streams.session_counts(stream, "user_id", "ts", "6 hours", "1 hour").writeStream.outputMode("complete").format("memory").queryName("sessions_out")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("sessions_out").collect()} == want


def test_upsert_stream_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "old", dt.datetime(2026, 1, 1))], "id int, v string, first_seen_at timestamp_ntz").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    run = streams.upsert_sink(read, lambda df: merges.swap(spark, df, path), ["id"], "o", "2026-02-01")
    batch = spark.createDataFrame([(1, "new", 1), (2, "x", 1)], "id int, v string, o int")
    for epoch in (0, 0):
        run(batch, epoch)
    assert sorted((r["id"], r["v"], r["first_seen_at"].month) for r in read().collect()) == [(1, "new", 1), (2, "x", 2)]


def test_limiter_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=7 * i)) for i in range(40)] + [("b", t + dt.timedelta(seconds=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "c string, ts timestamp")
    want = sorted((r["c"], r["ts"], r["allowed"]) for r in sessions.anchored_windows(df, "c", "ts", 5, 60).collect())
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.limited(stream, "c", "ts", 5, 60).writeStream.outputMode("append").format("memory").queryName("limited_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    # Batches without data follow as long as state may time out, so the query is never idle.
    until = time.time() + 60
    while time.time() < until and spark.table("limited_out").count() < len(rows):
        time.sleep(0.5)
    q.stop()
    assert sorted((r["c"], r["ts"], r["allowed"]) for r in spark.table("limited_out").collect()) == want


def test_limiter_goes_by_event_time(spark, tmp_path):
    """Requests out of order within a batch are counted in order, and a window spans batches however long the query stalls."""
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=s)) for s in (50, 0, 10, 61, 30, 20)]
    later = [("a", t + dt.timedelta(seconds=s)) for s in (70, 65, 100)]
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(part, "c string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        spark.read.parquet(str(tmp_path / f"in{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.limited(stream, "c", "ts", 3, 60, "10 minutes").writeStream.outputMode("append").format("memory").queryName("by_event_time")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = sorted((r["ts"], r["allowed"]) for r in spark.table("by_event_time").collect())
    assert [a for _, a in got] == [True, True, True, False, False, True, True, True, False]


def test_publishing_on_change_only(spark):
    held = {"df": None, "n": 0}

    def write(df):
        rows = df.collect()
        held["df"], held["n"] = spark.createDataFrame(rows, df.schema), held["n"] + 1

    run = streams.published(lambda: held["df"], write, "id", "id")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert run(one, 0) and not run(one, 1) and not run(one.limit(0), 2)
    assert run(spark.createDataFrame([(2, "c")], "id int, v string"), 3) and held["n"] == 2
    assert sorted(map(tuple, held["df"].collect())) == [(1, "a"), (2, "c")]


def test_anchored_windows_fold(spark):
    """One pass over slices of any length, over batch borders, against a plain loop; rows without an instant are left out."""
    import random

    r = random.Random(3)
    t = dt.datetime(2026, 1, 1)
    rows = [(r.choice("aab"), t + dt.timedelta(seconds=r.randrange(0, 40_000)), i) for i in range(3_000)] + [("a", None, -1)]
    df = spark.createDataFrame(rows, "c string, ts timestamp, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x["i"]: x["allowed"] for x in sessions.anchored_windows(df, "c", "ts", 4, 60, "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in "ab":
        start, n = None, 0
        for _, at, i in sorted((x for x in rows if x[0] == c and x[1]), key=lambda x: (x[1], x[2])):
            if start is None or (at - start).total_seconds() >= 60:
                start, n = at, 0
            n += 1
            want[i] = n <= 4
    assert got == want


def test_package_reaches_the_workers(spark):
    """Once per application, whatever the working directory."""
    from feedloom import runtime

    runtime.ship(spark)
    before = len(spark.sparkContext._python_includes)
    runtime.ship(spark)
    assert before == len(spark.sparkContext._python_includes) >= 1
