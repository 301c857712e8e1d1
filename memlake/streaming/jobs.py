"""Jobs by key as a stream: at most one in flight for a key, run when its quiet time is over.

A request for a conversation opens a job; further requests join the job that is open.  A job is run at
its due time, one for each key and tick: it goes from pending to in progress, with one attempt more, and
from there to completed, or to failed with the error of the work.  A request after that opens the next.

State is one small row a key, in a state store that checkpoints with the stream.  What a key does
depends on the times of its requests alone: a request that comes after a job's due time finds it run,
whether or not its timer has fired in a batch of its own.  So files may be cut into batches in any way,
and a stream that is killed and started again from its checkpoint gives the same rows.

Scale: keys are spread by hash, and a task's keys pass to Python together with their states, without a
call for each; requests are reduced to (key, time, flag) before the shuffle.  A task
holds one batch's requests of one key to put them in order; ``files`` at the source bounds a batch.

Defined results: requests without a time or key are left out; requests of equal time count all; one that
comes later than the watermark's delay is dropped by the engine; an empty stream has no jobs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PENDING, RUNNING, DONE, FAILED = "pending", "in_progress", "completed", "failed"
#: One row for each step of a job; steps are numbered within a key.
LOG = "key long, job long, step long, status string, attempts int, last_error string, created long, tried long, requests long"
_LOG = [c.split()[0] for c in LOG.split(", ")]
_TYPES = {"status": object, "last_error": object, "attempts": "int32", "tried": "Int64"}
#: State of a key: its last job and step, and whether the job is open.
STATE = "job long, step long, created long, due long, requests long, flagged long, open boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (key, requests, flagged requests) of a job; raises to fail it.
Work = Callable[[int, int, int], None]


def reflect(key: int, requests: int, flagged: int) -> None:
    """The default work: there must be something that a user said."""
    if not flagged:
        raise ValueError("nothing to reflect on")


class Jobs:
    """What a key does with its requests and at its due time; a key has one timer, that of its open job."""

    def __init__(self, work: Work, quiet_ms: int):
        self.work, self.quiet_ms = work, quiet_ms

    def _run(self, key: int, s: list, log: list) -> None:
        """The tick at which a job is due."""
        job, _, created, due, requests, flagged, _ = s
        try:
            self.work(key, requests, flagged)
            end, error = DONE, None
        except Exception as e:  # a job's failure is its result
            end, error = FAILED, str(e)
        for status, said in ((RUNNING, None), (end, error)):
            s[1] += 1
            log.append((key, job, s[1], status, 1, said, created, due, requests))
        s[6] = False

    @staticmethod
    def _frames(log: list) -> Iterator[pd.DataFrame]:
        if log:
            columns = zip(_LOG, zip(*log, strict=True), strict=True)
            yield pd.DataFrame({name: pd.array(x, dtype=_TYPES.get(name, "int64")) for name, x in columns})

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (k,), log = key, []
        s = list(state.get if state.exists else (0, 0, 0, 0, 0, 0, False))
        if state.hasTimedOut:
            self._run(k, s, log)
        else:
            for at, flag in sorted((int(at), bool(flag)) for f in frames for at, flag in zip(f["at"], f["flag"], strict=True)):
                if s[6] and at >= s[3]:
                    self._run(k, s, log)
                if not s[6]:
                    s = [s[0] + 1, s[1] + 1, at, at + self.quiet_ms, 0, 0, True]
                    log.append((k, s[0], s[1], PENDING, 0, None, at, None, 1))
                s[4] += 1
                s[5] += flag
        state.update(tuple(s))
        if s[6]:
            # A timer fires once the watermark is beyond it; a job is due once the watermark is there.
            state.setTimeoutTimestamp(s[3] - 1)
        yield from self._frames(log)


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep their state in the store that timers and typed state need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def job_log(requests: DataFrame, quiet_s: int = 60, delay: str = "10 minutes", work: Work = reflect) -> DataFrame:
    """The steps of all jobs, from a stream of requests (key, ts, flag)."""
    r = requests.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("long").alias("key"), "ts", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("at"), F.coalesce("flag", F.lit(False)).alias("flag"))
    return r.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(Jobs(work, quiet_s * 1000), LOG, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run(log: DataFrame, out: str, checkpoint: str, after: Callable[[int], None] = lambda number: None) -> StreamingQuery:
    """Write a log's batches under their numbers, so that a batch which is run again replaces what it left."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        after(number)

    with keyed_state(log.sparkSession):
        return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """Each job as its last step left it: (key, job, status, attempts, last_error, created, tried, requests)."""
    last = log.groupBy("key", "job").agg(F.max_by(F.struct("status", "attempts", "last_error", "created", "tried", "requests"), "step").alias("x"))
    return last.select("key", "job", "x.*")
