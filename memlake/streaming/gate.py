"""Entropy gate: whether a message says enough that its conversation hasn't heard yet.

Two halves, equally weighted unless told otherwise: the share of a message's keywords that no earlier
message of its conversation had, and the cosine distance of its vector from that of the message before;
without keywords, or without a message before, a half is 1.  A message with a score below the threshold
isn't admitted; admitted or not, it counts as heard.

``gated`` is for tables and streams alike: for a table, a keyword is new where its first occurrence is,
and the message before is found by place; for a stream, keywords heard and the last vector are keyed
state.  Both give the same rows.

Scale of the table form: the first occurrence is a minimum by (conversation, keyword), pre-aggregated
before its shuffle; places come from range partitions, so a conversation with a third of all messages
is many tasks; joins are equi-joins on (conversation, turn) or (conversation, keyword).  In the stream
form a conversation is one key; its keywords are separate entries of the state, of which a message
touches its own only.

Defined results: null keywords are none; a null vector, or one of another length, has distance 1 from
any; repeated keywords of a message count once; messages of one turn are told apart by their order of
keywords, so ids should be unique; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlake.functions import vectors
from memlake.operators.temporal import places

THRESHOLD, ALPHA = 0.35, 0.5
SCHEMA = "conv_id long, turn long, keyword_novelty double, semantic_novelty double, score double, admitted boolean"


def _scored(kw: Column, sem: Column, threshold: float, alpha: float) -> list[Column]:
    score = F.lit(alpha) * kw + F.lit(1 - alpha) * sem
    return [kw.alias("keyword_novelty"), sem.alias("semantic_novelty"), score.alias("score"), (score >= threshold).alias("admitted")]


def of_table(messages: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    """(conv_id, turn, keyword_novelty, semantic_novelty, score, admitted) of (conv_id, turn, keywords, vector)."""
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.array_distinct("keywords").alias("keywords"), F.col("vector").cast("array<double>").alias("vector"))
    said = m.select("conv_id", "turn", F.explode("keywords").alias("word"))
    first = said.groupBy("conv_id", "word").agg(F.min("turn").alias("first"))
    new = said.join(first, ["conv_id", "word"]).groupBy("conv_id", "turn").agg(F.avg((F.col("turn") == F.col("first")).cast("double")).alias("share"))
    placed = places(m.select("conv_id", "turn", "vector"), ["conv_id"], ["turn"])
    before = placed.select("conv_id", (F.col("idx") + 1).alias("idx"), F.col("vector").alias("previous"), F.lit(True).alias("follows"))
    x = placed.join(before, ["conv_id", "idx"], "left").join(new, ["conv_id", "turn"], "left")
    sem = F.when(F.col("follows"), 1 - vectors.cosine("vector", F.col("previous"))).otherwise(1.0)
    return x.select("conv_id", "turn", *_scored(F.coalesce("share", F.lit(1.0)), sem, threshold, alpha))


class Gate(StatefulProcessor):
    """State of a conversation: the keywords heard, one entry each, and the last vector."""

    def __init__(self, threshold: float, alpha: float):
        self.threshold, self.alpha = threshold, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heard = handle.getMapState("heard", "word string", "turn long")
        self.last = handle.getValueState("last", "vector array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, state = [], self.last.get()
        last = np.array(state[0] if state[0] is not None else [], float) if state else None
        asked = sorted(((r.turn, r.keywords, r.vector) for f in rows for r in f.itertuples()), key=lambda r: r[0])
        for turn, keywords, vector in asked:
            words = dict.fromkeys(() if keywords is None else keywords)
            new = [w for w in words if not self.heard.containsKey((w,))]
            kw = len(new) / len(words) if words else 1.0
            v = np.array([] if vector is None else vector, float)
            sem = 1.0 if last is None else 1 - _cosine(v, last)
            score = self.alpha * kw + (1 - self.alpha) * sem
            out.append((key[0], turn, kw, sem, score, score >= self.threshold))
            for w in new:
                self.heard.updateValue((w,), (turn,))
            last = v
        self.last.update((None if last is None else last.tolist(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b)) if len(a) == len(b) else 0.0
    return float(a @ b) / n if n > 0 else 0.0


def of_stream(messages: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    """The same rows from a stream; start it within ``jobs.keyed_state``."""
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "keywords", F.col("vector").cast("array<double>").alias("vector"))
    return m.groupBy("conv_id").transformWithStateInPandas(Gate(threshold, alpha), SCHEMA, "Append", "None")


def gated(messages: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    return (of_stream if messages.isStreaming else of_table)(messages, threshold, alpha)
