"""Queries that run a stream to its end and return what it wrote: jobs, the entropy gate, the outbox."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.plans.core import M, mem
from memlake.plans.rules import _FSTOP
from memlake.registry import query
from memlake.sources.tables import shared_dir, table
from memlake.streaming import gate, jobs, outbox, queues

# Turns of a conversation are 20 to 80 seconds apart; conversations start seven minutes apart.
_AT = "1704067200000 + (conv_id * 7 % 1440) * 60000 + turn * (20 + conv_id % 5 * 15) * 1000"


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/memlake/{name}-{uuid.uuid4().hex}"


def requests(s: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation asks for a reflection on it; a stream of (key, ts, flag)."""
    # A pattern, as the table may be one file or a folder of files.
    turns = queues.source(s, f"{d}/conversations.parque[t]", table(s, d, "conversations").schema)
    return turns.select(F.col("conv_id").alias("key"), F.timestamp_millis(F.expr(_AT)).alias("ts"), (F.col("role") == "user").alias("flag"))


def run_jobs(s: SparkSession, d: str) -> DataFrame:
    out = folder(s, "jobs")
    jobs.run(jobs.job_log(requests(s, d)), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return jobs.latest(s.read.schema(jobs.LOG).parquet(f"{out}/log"))


_JOBS_SQL = f"""
WITH RECURSIVE r AS (SELECT conv_id, role = 'user' AS flag, {_AT} AS asked FROM conversations),
j AS (
  SELECT conv_id, 1::BIGINT AS job, min(asked) AS created FROM r GROUP BY conv_id
  UNION ALL
  SELECT j.conv_id, j.job + 1, min(r.asked) FROM j JOIN r ON r.conv_id = j.conv_id AND r.asked >= j.created + 60000 GROUP BY j.conv_id, j.job),
n AS (
  SELECT j.conv_id, j.job, j.created, count(*) AS requests, count(*) FILTER (WHERE flag) AS flagged,
         j.job < max(j.job) OVER (PARTITION BY j.conv_id) OR j.created + 60000 <= (SELECT max(asked) - 600000 FROM r) AS due
  FROM j JOIN r ON r.conv_id = j.conv_id AND r.asked >= j.created AND r.asked < j.created + 60000 GROUP BY j.conv_id, j.job, j.created)
SELECT conv_id, job, CASE WHEN NOT due THEN 'pending' WHEN flagged > 0 THEN 'completed' ELSE 'failed' END AS status, due::INT AS attempts,
       CASE WHEN due AND flagged = 0 THEN 'nothing to reflect on' END AS last_error, created, CASE WHEN due THEN created + 60000 END AS tried, CASE WHEN due THEN requests ELSE 1 END AS requests
FROM n"""


@query("q2_reflection_jobs", _JOBS_SQL)
def reflection_jobs(s, d):
    return run_jobs(s, d).withColumnRenamed("key", "conv_id")


def messages(s: SparkSession, d: str) -> DataFrame:
    """Memories as messages of their episodes: (conv_id, turn, keywords, vector)."""
    m = mem(s, d)
    return m.select(F.col("episode_id").alias("conv_id"), F.col("id").alias("turn"), F.array_distinct(R.fact_keywords(F.coalesce("content", F.lit("")))).alias("keywords"), F.col("embedding").cast("array<double>").alias("vector"))


_WORDS = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(content, '')), '[^a-z0-9\s-]', '', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({_FSTOP}, w))[1:10])"
_GATE_SQL = M(
    f""", msg AS (SELECT episode_id AS conv_id, id AS turn, {_WORDS} AS keywords, embedding::DOUBLE[] AS vector FROM memories),
    word AS (SELECT conv_id, turn, unnest(keywords) AS word FROM msg),
    new AS (SELECT conv_id, turn, avg((turn = first)::INT) AS share FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, word) AS first FROM word) GROUP BY conv_id, turn),
    half AS (
      SELECT m.conv_id, m.turn, coalesce(n.share, 1.0)::DOUBLE AS kw, CASE WHEN before IS NULL THEN 1.0 ELSE 1 - list_cosine_similarity(vector, before) END::DOUBLE AS sem
      FROM (SELECT *, lag(vector) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM msg) m LEFT JOIN new n ON m.conv_id = n.conv_id AND m.turn = n.turn)
    SELECT conv_id, turn, round(kw, 6) AS keyword_novelty, round(sem, 6) AS semantic_novelty, round(0.5 * kw + 0.5 * sem, 6) AS score, round(0.5 * kw + 0.5 * sem, 6) >= 0.35 AS admitted FROM half"""
)


def _rounded(x: DataFrame) -> DataFrame:
    kw, sem, score = (F.round(c, 6).alias(c) for c in ("keyword_novelty", "semantic_novelty", "score"))
    return x.select("conv_id", "turn", kw, sem, score, (F.round("score", 6) >= gate.THRESHOLD).alias("admitted"))


@query("c18_entropy_gate", _GATE_SQL)
def entropy_gate(s, d):
    return _rounded(gate.gated(messages(s, d)))


@query("q7_message_gate", _GATE_SQL)
def message_gate(s, d):
    """The same through keyed state: messages are written as a queue and read as a stream."""
    out = folder(s, "gate")
    messages(s, d).write.parquet(f"{out}/in")
    stream = queues.source(s, f"{out}/in", s.read.parquet(f"{out}/in").schema)
    with jobs.keyed_state(s):
        q = gate.gated(stream).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return _rounded(s.read.schema(gate.SCHEMA).parquet(f"{out}/out"))


# Outbox ------------------------------------------------------------------------------------------

TICKS, STEP_S = 6, 40
_POLICY = outbox.Policy(batch=1 << 30, base_s=30, most_s=100, attempts=3)
#: What the receiver answers: errors time out twice, sign-ups always, purchases of an odd user are refused.
_STATUS = "CASE WHEN kind = 'error' AND attempts < 2 THEN 503 WHEN kind = 'signup' THEN 429 WHEN kind = 'purchase' AND event_id % 2 = 1 THEN 400 ELSE 200 END"


def run_outbox(s: SparkSession, d: str) -> tuple[outbox.Outbox, str]:
    """All events as outbox rows, six ticks forty seconds apart; the box, and the folder of what the receiver has."""
    out = folder(s, "outbox")
    box = outbox.Outbox(s, f"{out}/box", _POLICY)
    e = table(s, d, "events")
    box.put(e.select("event_id", F.col("event_type").alias("payload"), F.unix_seconds(F.col("ts").cast("timestamp_ltz")).alias("created_s")), 0)

    def receiver(rows: DataFrame, number: int) -> DataFrame:
        said = rows.withColumn("status", F.expr(_STATUS.replace("kind", "payload")).cast("int"))
        said.where("status = 200").select("event_id", "payload").write.mode("overwrite").parquet(f"{out}/sink/batch={number}")
        return said.select("event_id", "status", F.lit(None).cast("long").alias("retry_after_s"))

    for k in range(TICKS):
        box.tick(receiver, k * STEP_S)
    return box, f"{out}/sink"


_OUTBOX_SQL = f"""
WITH RECURSIVE t AS (
  SELECT 0 AS k, event_id, event_type AS kind, 'pending' AS state, 0 AS attempts, 0 AS next_s, NULL::VARCHAR AS error, NULL::INT AS sent_s FROM events
  UNION ALL
  SELECT k + 1, event_id, kind,
    CASE WHEN NOT due THEN state WHEN status = 200 THEN 'sent' WHEN status IN (429, 503) AND attempts < 2 THEN 'pending' ELSE 'dead_letter' END,
    CASE WHEN due AND status IN (429, 503) AND attempts < 2 THEN attempts + 1 ELSE attempts END,
    CASE WHEN due AND status IN (429, 503) AND attempts < 2 THEN k * {STEP_S} + least(100, 30 * (1 << attempts)) ELSE next_s END,
    CASE WHEN NOT due THEN error WHEN status <> 200 THEN 'http_' || status END, CASE WHEN due AND status = 200 THEN k * {STEP_S} ELSE sent_s END
  FROM (SELECT *, state = 'pending' AND next_s <= k * {STEP_S} AS due, {_STATUS} AS status FROM t WHERE k < {TICKS}))
SELECT event_id, state, attempts::INT AS attempts, error, sent_s::BIGINT AS sent_s, (state = 'sent')::BIGINT AS delivered FROM t WHERE k = {TICKS}"""


@query("q4_outbox", _OUTBOX_SQL)
def outbox_states(s, d):
    box, sink = run_outbox(s, d)
    got = s.read.schema("event_id long, payload string").parquet(sink).groupBy("event_id").agg(F.count(F.lit(1)).alias("delivered"))
    return box.table().join(got, "event_id", "left").select("event_id", "state", "attempts", "error", "sent_s", F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered"))
