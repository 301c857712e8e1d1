"""What keyed state costs a key: tasks pass keys and states to Python together, not by a call for each."""

from memlake.streaming import jobs


def test_requests_need_no_calls_for_each_key(spark, tmp_path):
    spark.createDataFrame([(1, 1_000_000, True)], "key long, at long, flag boolean").write.parquet(f"{tmp_path}/in")
    r = spark.readStream.schema("key long, at long, flag boolean").parquet(f"{tmp_path}/in").selectExpr("key", "timestamp_millis(at) AS ts", "flag")
    plan = jobs.job_log(r)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
