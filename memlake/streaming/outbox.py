"""Outbox: rows that must reach a receiver once, kept as versions of a table.

A tick claims rows that are due, delivers them as one numbered batch and settles what the receiver said.
Each step is a DataFrame of the next version, which is written whole and then becomes the latest, so a
tick that dies leaves the version before it.  A batch is claimed in one version and delivered after it;
a driver that comes back delivers an open batch again under its own number, and a receiver that replaces
what it has under a number holds each row once.  Another worker takes an open batch over when its claim
is older than ``stale_s``.

Retries wait base * 2^attempts, at most ``most_s``, or as long as the receiver asks; a row that failed
``attempts`` times, or was refused, is a dead letter.  Sent and dead rows leave after their retention.

Scale: a tick reads and writes the rows still kept, which retention bounds, by DataFrame operations;
the rows of a batch are a top-k, ``batch`` at most; only the version number is known to the driver.

Defined results: a row whose id is known is ignored; of new rows with one id the first in order stays;
a null status is a network error; nothing due gives an empty batch, which isn't delivered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, payload string, state string, attempts int, next_s long, error string, created_s long, claimed_s long, batch long, sent_s long, dead_s long"
PENDING, CLAIMED, SENT, DEAD = "pending", "claimed", "sent", "dead_letter"

#: Delivers the rows of a batch under its number, replacing what it has of it: (event_id, status, retry_after_s).
Receiver = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Policy:
    batch: int = 50
    stale_s: int = 300
    base_s: int = 5
    most_s: int = 300
    attempts: int = 5
    keep_sent_s: int = 86_400
    keep_dead_s: int = 7 * 86_400


def enqueue(box: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """box with new rows (event_id, payload, created_s), due at once."""
    one = rows.groupBy("event_id").agg(F.min_by(F.struct("payload", "created_s"), F.struct("created_s", "payload")).alias("x")).select("event_id", "x.*")
    new = one.join(box.select("event_id"), "event_id", "left_anti").select("event_id", "payload", F.lit(PENDING).alias("state"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("next_s"), "created_s")
    return box.unionByName(new, allowMissingColumns=True)


def claim(box: DataFrame, number: int, now: int, policy: Policy) -> DataFrame:
    """box with the oldest rows that are due, or whose claim is stale, claimed as a batch."""
    due = ((F.col("state") == PENDING) & (F.col("next_s") <= now)) | ((F.col("state") == CLAIMED) & (F.col("claimed_s") < now - policy.stale_s))
    mine = box.where(due).orderBy("created_s", "event_id").limit(policy.batch).select("event_id", F.lit(True).alias("_mine"))
    x = box.join(mine, "event_id", "left")
    change = lambda c, value: F.when(F.col("_mine"), F.lit(value)).otherwise(F.col(c)).alias(c)
    return x.select(*[change(c, {"state": CLAIMED, "claimed_s": now, "batch": number}[c]) if c in ("state", "claimed_s", "batch") else F.col(c) for c in box.columns])


def settle(box: DataFrame, said: DataFrame, number: int, now: int, policy: Policy) -> DataFrame:
    """box after what a receiver said about a batch: (event_id, status, retry_after_s)."""
    status = F.col("_status")
    x = box.join(said.select("event_id", F.lit(True).alias("_said"), F.col("status").alias("_status"), F.col("retry_after_s").alias("_after")), "event_id", "left")
    x = x.withColumn("_said", F.coalesce("_said", F.lit(False)) & (F.col("batch") == number) & (F.col("state") == CLAIMED))
    fine, locked = F.coalesce(status.isin(200, 201), F.lit(False)), F.coalesce(status.isin(401, 403), F.lit(False))
    again = status.isNull() | status.isin(408, 429) | (status >= 500)
    spent = F.col("attempts") + 1 >= policy.attempts
    backoff = F.least(F.lit(float(policy.most_s)), policy.base_s * F.pow(F.lit(2.0), F.col("attempts"))).cast("long")
    state = F.when(fine, SENT).when(locked | (again & ~spent), PENDING).otherwise(DEAD)
    error = F.when(~fine, F.coalesce(F.concat(F.when(locked, "auth_").otherwise("http_"), status.cast("string")), F.lit("network_error")))
    wait = F.when(locked, F.lit(policy.most_s).cast("long")).otherwise(F.coalesce("_after", backoff))
    x = x.withColumn("_to", state)
    new = {
        "state": F.col("_to"),
        "attempts": F.when(F.col("_to") == PENDING, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "next_s": F.when(F.col("_to") == PENDING, now + wait).otherwise(F.col("next_s")),
        "error": error,
        "claimed_s": F.when(F.col("_to") == SENT, F.col("claimed_s")),
        "sent_s": F.when(F.col("_to") == SENT, F.lit(now).cast("long")).otherwise(F.col("sent_s")),
        "dead_s": F.when(F.col("_to") == DEAD, F.lit(now).cast("long")).otherwise(F.col("dead_s")),
    }
    return x.select(*[F.when(F.col("_said"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in box.columns])


def purge(box: DataFrame, now: int, policy: Policy) -> DataFrame:
    old = lambda state, at, keep: (F.col("state") == state) & (F.col(at) < now - keep)
    return box.where(~(F.coalesce(old(SENT, "sent_s", policy.keep_sent_s) | old(DEAD, "dead_s", policy.keep_dead_s), F.lit(False))))


def health(box: DataFrame, now: int) -> DataFrame:
    """One row: pending (claimed ones too), dead, age of the oldest pending row, status."""
    waits = F.col("state").isin(PENDING, CLAIMED)
    x = box.agg(F.count_if(waits).alias("pending"), F.count_if(F.col("state") == DEAD).alias("dead"), (now - F.min(F.when(waits, F.col("created_s")))).alias("oldest_s"))
    bad: Column = (F.col("dead") > 0) | (F.coalesce("oldest_s", F.lit(0)) > 300)
    return x.withColumn("status", F.when(bad, "degraded").otherwise("healthy"))


class Outbox:
    """An outbox in a folder that all executors share.  Versions are Parquet folders, the latest complete one counts."""

    def __init__(self, spark: SparkSession, folder: str, policy: Policy | None = None):
        self.spark, self.folder, self.policy = spark, folder.rstrip("/"), policy or Policy()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version that was written to its end; 0 if there is none."""
        root, fs = self._fs(self.folder)
        if not fs.exists(root):
            return 0
        done = [int(s.getPath().getName().removeprefix("v")) for s in fs.listStatus(root) if s.getPath().getName().startswith("v") and fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[0])]
        return max(done, default=0)

    def table(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{n}") if n else self.spark.createDataFrame([], SCHEMA)

    def _write(self, box: DataFrame) -> None:
        n = self.version()
        box.write.mode("overwrite").parquet(f"{self.folder}/v{n + 1}")
        if n > 1:  # the version before the last isn't read any more
            path, fs = self._fs(f"{self.folder}/v{n - 1}")
            fs.delete(path, True)

    def put(self, rows: DataFrame, now: int) -> None:
        self._write(enqueue(self.table(), rows, now))

    def tick(self, receiver: Receiver, now: int) -> int:
        """One round of a worker that died or didn't: an open batch of its own first, else a new one.  Returns the batch, 0 for none."""
        box = self.table()
        open_ = box.where((F.col("state") == CLAIMED) & (F.col("claimed_s") >= now - self.policy.stale_s)).agg(F.max("batch")).first()[0]
        if open_ is None:
            number = (box.agg(F.max("batch")).first()[0] or 0) + 1
            self._write(claim(box, number, now, self.policy))
        else:
            number = open_
        box = self.table()
        rows = box.where((F.col("batch") == number) & (F.col("state") == CLAIMED))
        if rows.isEmpty():
            return 0
        said = receiver(rows.select("event_id", "payload", "attempts"), number)
        self._write(purge(settle(box, said, number, now, self.policy), now, self.policy))
        return number
