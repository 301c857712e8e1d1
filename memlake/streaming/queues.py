"""Queues as streams: incremental processing with idempotent batches, dead letters and event-time windows.

Every stream is started by a caller who gives source, sink and checkpoint location; tests and
backfills use the available-now trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def drain(stream: DataFrame, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], done: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Process a queue in micro-batches: work returns (done, dead-lettered) rows.

    A batch is written under its number, replacing what an earlier attempt at it left, so that a
    retried batch is not written twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        good, bad = work(df)
        good.write.mode("overwrite").parquet(f"{done}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dirty_subjects(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Subjects marked for a new summary, each once within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type", "ts")


def quiet_periods(stream: DataFrame, gap: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Work that is due when a user has been quiet for the gap."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows; the same for streams and tables."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def novelty(stream: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Entropy gate, message by message: the share of a message's keywords that its conversation hasn't had yet.

    stream: (conv_id, turn, keywords); state is the set of keywords seen in a conversation.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        out = []
        for f in frames:
            for r in f.sort_values("turn").itertuples():
                words = set(r.keywords)
                share = len(words - seen) / len(words) if words else 0.0
                out.append((key[0], r.turn, round(share, 6), share >= threshold))
                seen |= words
        state.update((sorted(seen),))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "novelty", "admitted"])

    return stream.groupBy("conv_id").applyInPandasWithState(gate, "conv_id long, turn long, novelty double, admitted boolean", "seen array<string>", "append", GroupStateTimeout.NoTimeout)
