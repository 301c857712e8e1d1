"""Rank fusion, merging and re-ranking of result lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.search import RRF_K, top_k

#: Weights of the channels.
CHANNELS = {"semantic": 1.2, "entity": 1.3, "keyword": 1.0, "hierarchical": 1.4, "topic": 1.15, "recap": 1.5}


def rrf(channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """channels: (channel, weight, ord, rank, id, score) -> (id, fused, score), score from the first channel."""
    return channels.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("fused"), F.min_by("score", "ord").alias("score"))


def stage_merge(first: DataFrame, second: DataFrame, weight: float = 1.0) -> DataFrame:
    """Union of two lists (id, score, ranking_score), the second's scores weighted, the better row of each id."""
    scaled = second.select("id", (F.col("score") * weight).alias("score"), (F.col("ranking_score") * weight).alias("ranking_score"))
    key = F.coalesce("ranking_score", "score")
    both = first.select("id", "score", "ranking_score").unionByName(scaled).withColumn("key", key)
    return both.groupBy("id").agg(F.max_by(F.struct("score", "ranking_score"), F.struct("key", "score")).alias("x")).select("id", "x.*")


def repair_accepted(before: DataFrame, after: DataFrame, least: float = 0.01, floor: float = 0.3) -> DataFrame:
    """One row: top scores and whether the repaired list is taken."""
    a = before.agg(F.max("score").alias("before"))
    b = after.agg(F.max("score").alias("after"))
    d = F.col("after") - F.col("before")
    return a.crossJoin(b).withColumn("accepted", ~((F.col("before") > 0.6) & (d < 0)) & (d >= least) & (F.col("after") >= floor))


def weighted_criteria(scores: Column, weights: dict[str, float]) -> Column:
    """Weighted mean of a map of scores over the criteria that are there."""
    total = lambda of: sum((F.when(scores[k].isNotNull(), of(k)).otherwise(0.0) for k in weights), F.lit(0.0))
    w = total(lambda k: F.lit(weights[k]))
    return F.when(w > 0, total(lambda k: scores[k] * weights[k]) / w).otherwise(0.0)


def min_max(df: DataFrame, column: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Scaled to 0..1; 1 if all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(1.0))


def mmr(rows: DataFrame, k: int, lam: float = 0.85, by: str = "query_id") -> DataFrame:
    """Greedy diversity: score * lam - (1 - lam) * largest cosine with what is chosen (0 at least).

    rows: (by, id, score, embedding), a candidate list of bounded depth for each query.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        e = np.array(pdf["embedding"].tolist(), np.float64)
        e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
        most, chosen = np.zeros(len(pdf)), []
        left = np.ones(len(pdf), bool)
        for _ in range(min(k, len(pdf))):
            value = np.where(left, lam * pdf["score"].to_numpy() - (1 - lam) * most, -np.inf)
            j = int(value.argmax())
            chosen.append(j)
            left[j] = False
            most = np.maximum(most, e @ e[j])
        return pd.DataFrame({by: pdf[by].iloc[0], "id": pdf["id"].iloc[chosen].to_numpy(), "pick": range(1, len(chosen) + 1)})

    t = dict(rows.dtypes)
    return rows.select(by, "id", "score", "embedding").groupBy(by).applyInPandas(pick, f"{by} {t[by]}, id {t['id']}, pick int")


def protect(rows: DataFrame, k: int, by: str) -> DataFrame:
    """The first k of each list with its protected rows among them, in order of score; rows: (by, id, score, protected).

    Swapping the lowest unprotected rows out for protected ones ends at the protected rows first.
    """
    kept = top_k(rows, k, F.desc("protected"), F.desc("score"), F.asc("id"), by=(by,))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))


def current_state(rows: DataFrame, by: str, historical: bool = False) -> DataFrame:
    """Recency rank within the list and wording adjust the score; for historical questions the other way round."""
    n = F.col("_n")
    rows = rows.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by)
    c = F.lower("content")
    move = c.rlike("(switched|migrated|moved|changed|replaced)")
    now, past = c.rlike("(now|current|currently|latest)"), c.rlike("(previously|formerly|used to|no longer)")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), "id"))
    bonus = 2.5 * (n - (place - 1)) / n + F.when(move, 1.5).otherwise(0.0) + F.when(now, 0.45).otherwise(0.0) - F.when(past, 0.6).otherwise(0.0)
    return rows.withColumn("adjusted", F.col("score") + (-bonus if historical else bonus)).drop("_n")


def concise(rows: DataFrame, by: str) -> DataFrame:
    """Texts longer than their list's (upper) median and 150 characters lose up to 15 % of their score."""
    middle = rows.groupBy(by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(content) DESC)").alias("median"))
    n, median = F.length("content"), F.col("median")
    over = F.least(F.lit(1.0), (n - median) / F.greatest(median, F.lit(1)))
    return rows.join(middle, by).withColumn("adjusted", F.when((n > median) & (n > 150), F.col("score") * (1 - 0.15 * over)).otherwise(F.col("score")))


def month_boost(rows: DataFrame, month: int, year: int, boost: float = 1.0) -> DataFrame:
    hit = (F.month("created_at") == month) & (F.year("created_at") == year)
    return rows.withColumn("adjusted", F.col("score") + F.when(hit, boost).otherwise(0.0))


def state_rerank(score: Column, state: Column) -> Column:
    return score + F.when(state == "current", 0.1).when(state == "past", -0.1).otherwise(0.0)


def rerank(rows: DataFrame, model, by: str = "query_id", skip_top: float = 0.85, skip_gap: float = 0.05) -> DataFrame:
    """Blend 0.7 * sigmoid(model logit) + 0.3 * score / max, unless the top is strong and clear.

    model: a function from a list of texts to logits, called on Arrow batches.
    """
    w = Window.partitionBy(by)
    order = w.orderBy(F.desc("score"), "id")
    top, second = F.max("score").over(w), F.max(F.when(F.col("_rn") == 2, F.col("score"))).over(w)

    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model(b.tolist()), dtype="float64")

    f = F.pandas_udf(logits, "double")
    rows = rows.withColumn("_rn", F.row_number().over(order))
    rows = rows.withColumn("_skip", (top >= skip_top) & (top - F.coalesce(second, F.lit(0.0)) >= skip_gap)).withColumn("_top", top)
    fresh = 0.7 / (1 + F.exp(-f("content"))) + 0.3 * F.col("score") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return rows.withColumn("reranked", F.when(F.col("_skip"), F.col("score")).otherwise(fresh)).drop("_rn", "_skip", "_top")


def adaptive_limit(label: str, most: int = 50) -> int:
    """Results by the query's complexity."""
    return min(most, {"simple": 5, "medium": 5, "complex": 8, "multi-hop": 12, "aggregation": 25}[label])
