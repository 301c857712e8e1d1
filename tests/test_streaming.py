"""Streams give what the same table gives in one go."""

from pyspark.sql import functions as F

from memlake.streaming import queues


def events(spark, path, n=60):
    df = spark.range(n).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 7)).alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_drain_processes_each_row_once(spark, tmp_path):
    df = events(spark, f"{tmp_path}/in")
    split = lambda x: (x.where("value >= 5"), x.where("value < 5"))
    args = (f"{tmp_path}/done", f"{tmp_path}/dead", f"{tmp_path}/cp")
    for _ in range(2):
        queues.drain(queues.source(spark, f"{tmp_path}/in", df.schema, files=1), split, *args).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/done").count() == 55
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 5


def test_windows_match_the_batch(spark, tmp_path):
    df = events(spark, f"{tmp_path}/in")
    q = queues.windowed(queues.source(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda x: sorted((str(r["window"]), r["event_type"], r["n"], r["total"]) for r in x.collect())
    assert key(spark.table("w")) == key(queues.windowed(df))


def test_novelty_keeps_state(spark, tmp_path):
    rows = [(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, ["a", "c"]), (2, 1, ["a"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, keywords array<string>")
    df.write.parquet(f"{tmp_path}/in")
    q = queues.novelty(queues.source(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("nv").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["conv_id"], r["turn"]): r["admitted"] for r in spark.table("nv").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True}
