"""Streams with keyed state: jobs survive a kill, the gate's two forms agree."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.streaming import gate, jobs, queues

SCHEMA = "key long, at long, flag boolean"


def write(spark, path, rows, files):
    """Rows in files, in order, one write for each, so that a stream reads them in that order."""
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def log_of(spark, path, files=None, **options):
    r = queues.source(spark, path, spark.read.parquet(path).schema, files)
    return jobs.job_log(r.select("key", F.timestamp_millis("at").alias("ts"), "flag"), **options)


def brute(rows, quiet=60_000):
    """Jobs one request at a time: (key, job, created, requests, flagged)."""
    out = []
    for key in sorted({r[0] for r in rows}):
        job = None
        for _, at, flag in sorted(r for r in rows if r[0] == key):
            if job is None or at >= job[2] + quiet:
                job = [key, 1 if job is None else job[1] + 1, at, 0, 0]
                out.append(job)
            job[3] += 1
            job[4] += flag
    return out


@pytest.fixture
def requests():
    r = random.Random(5)
    rows = sorted(((r.randrange(4), (1 + r.randrange(900)) * 1000, r.random() < 0.3) for _ in range(120)), key=lambda x: x[1])
    return [*rows, (9, 10_000_000, True)]  # the last one ends every other job's quiet time


def test_jobs_in_one_batch_or_many(spark, tmp_path, requests):
    write(spark, f"{tmp_path}/in", requests, 4)
    got = {}
    for files in (None, 1):
        jobs.run(log_of(spark, f"{tmp_path}/in", files), f"{tmp_path}/{files}/out", f"{tmp_path}/{files}/cp").awaitTermination()
        got[files] = sorted(jobs.latest(spark.read.schema(jobs.LOG).parquet(f"{tmp_path}/{files}/out")).collect())
    assert got[None] == got[1]
    want = brute(requests)
    assert [(r["key"], r["job"], r["created"], r["requests"]) for r in got[1]] == [tuple(w[:4]) for w in want]
    for r, (key, _, created, _, flagged) in zip(got[1], want, strict=True):
        assert r["status"] == ("pending" if key == 9 else "completed" if flagged else "failed")
        assert (r["attempts"], r["tried"], r["last_error"]) == ((0, None, None) if key == 9 else (1, created + 60_000, None if flagged else "nothing to reflect on"))


def test_jobs_survive_a_kill_between_batches(spark, tmp_path, requests):
    write(spark, f"{tmp_path}/in", requests, 4)
    jobs.run(log_of(spark, f"{tmp_path}/in", 1), f"{tmp_path}/a/out", f"{tmp_path}/a/cp").awaitTermination()

    def kill(number):
        if number == kill.at:
            raise RuntimeError("killed after writing, before the batch is committed")

    for kill.at in (1, 2):
        with pytest.raises(Exception, match="killed"):
            jobs.run(log_of(spark, f"{tmp_path}/in", 1), f"{tmp_path}/b/out", f"{tmp_path}/b/cp", kill).awaitTermination()
    jobs.run(log_of(spark, f"{tmp_path}/in", 1), f"{tmp_path}/b/out", f"{tmp_path}/b/cp").awaitTermination()
    a, b = (sorted(spark.read.schema(jobs.LOG).parquet(f"{tmp_path}/{x}/out").drop("batch").collect(), key=str) for x in "ab")
    assert a == b and len(a) > 20


def test_work_that_fails_is_recorded(spark, tmp_path):
    def work(key, requests, flagged):
        if key == 1:
            raise RuntimeError("no model")

    write(spark, f"{tmp_path}/in", [(1, 1, True), (2, 1, False), (None, 1, True), (3, 9_000_000, True)], 1)
    jobs.run(log_of(spark, f"{tmp_path}/in", work=work), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["key"]: (r["status"], r["last_error"]) for r in jobs.latest(spark.read.schema(jobs.LOG).parquet(f"{tmp_path}/out")).collect()}
    assert got == {1: ("failed", "no model"), 2: ("completed", None), 3: ("pending", None)}
    steps = spark.read.schema(jobs.LOG).parquet(f"{tmp_path}/out").where("key = 1").orderBy("step").collect()
    assert [(r["status"], r["attempts"]) for r in steps] == [("pending", 0), ("in_progress", 1), ("failed", 1)]


def test_gate_of_stream_and_table(spark, tmp_path):
    r = random.Random(3)
    words = lambda: r.choice([None, [], [r.choice("abcdefg") for _ in range(r.randrange(1, 5))]])
    vector = lambda: r.choice([None, [1.0], [0.0, 0.0], [r.random(), r.random()], [r.random(), r.random()]])
    rows = [(c, t, words(), vector()) for c in range(4) for t in r.sample(range(100), 12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, keywords array<string>, vector array<double>")
    for part in ("turn < 40", "turn >= 40"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with jobs.keyed_state(spark):
        q = gate.gated(queues.source(spark, f"{tmp_path}/in", df.schema, 1)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda x: sorted((r["conv_id"], r["turn"], round(r["keyword_novelty"], 9), round(r["semantic_novelty"], 9), round(r["score"], 9), r["admitted"]) for r in x.collect())
    got = key(gate.gated(df))
    assert got == key(spark.read.parquet(f"{tmp_path}/out")) and len(got) == 48
    seen, want = {}, {}
    for c, t, kw, v in sorted(rows, key=lambda x: x[:2]):
        heard, last = seen.setdefault(c, (set(), []))
        kw = set(kw or ())
        share = len(kw - heard) / len(kw) if kw else 1.0
        dot = sum(a * b for a, b in zip(v or [], last[-1] or [])) if last else 0
        n = (sum(a * a for a in v or []) * sum(a * a for a in last[-1] or [])) ** 0.5 if last else 0
        cos = dot / n if n and len(v) == len(last[-1]) else 0.0
        want[c, t] = (round(share, 9), round(1 - cos if last else 1.0, 9))
        heard |= kw
        last.append(v)
    assert {(x[0], x[1]): (x[2], x[3]) for x in got} == want
