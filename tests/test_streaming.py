from pyspark.sql import functions as F

from lexforge.sources.snapshot import Library
from lexforge.streaming import indexing


def test_queue():
    q = indexing.IndexQueue()
    assert q.push(1, 2, 1) == 2 and q.next() == 1 and q.push(1, 3) == 1 and q.waiting == [2, 3]
    q.forget(2)
    q.forget(1)
    assert q.cancelled and q.waiting == [3] and q.busy()
    q.stop()
    assert q.next() is None and not q.busy()
    assert q.push(4) == 1 and q.next() == 4
    q.done()
    assert not q.busy()


def test_index_stream_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c")], "book_id long, chapter_id long, text string")
    rows.coalesce(1).write.parquet(source)
    progress = indexing.Progress()
    make = lambda df: df.withColumn("n", F.size(F.split("text", " ")))
    run = lambda: indexing.index_stream(spark, source, rows.schema, target, check, make, ["chapter_id"], progress).awaitTermination()
    run()
    assert spark.read.parquet(target).count() == 2 and progress.latest() == {1: 2}
    # A file that brings a chapter again, and a new one.
    spark.createDataFrame([(1, 2, "c"), (2, 3, "d e f")], rows.schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r["chapter_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    run()
    assert spark.read.parquet(target).count() == 3


def test_latest_positions_stream(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "lib", "check"))
    rows = spark.createDataFrame([(1, 10, 5), (1, 12, 6), (2, 3, 7)], "book_id long, ts long, block_id long")
    rows.write.parquet(source)
    run = lambda: indexing.save_positions(spark, source, rows.schema, target, check).awaitTermination()
    run()
    spark.createDataFrame([(1, 11, 9), (2, 8, 1)], rows.schema).write.mode("append").parquet(source)
    run()
    assert {(r["book_id"], r["block_id"]) for r in Library(spark, target).read("positions").collect()} == {(1, 6), (2, 1)}


def test_windows(spark):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'a', 1.0D), (1, timestamp'2024-01-01 00:00:00.5', 'b', 2.0D), (1, timestamp'2024-01-01 00:00:09', 'c', 4.0D) as t(user_id, ts, event_type, value)")
    assert [(r["n_events"], r["event_type"]) for r in indexing.debounced(rows).orderBy("session_start").collect()] == [(2, "b"), (1, "c")]
    assert indexing.tumbling_counts(rows).count() == 3


def test_event_time_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id as int),0,0,0) ts, 'x' event_type, 1.0D value from range(5)")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = indexing.tumbling_counts(stream).writeStream.outputMode("append").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.sql("select * from tumbling").collect()) == 3
