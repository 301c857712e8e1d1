"""Scored search over memories.  Every search is a batch: a table of queries against a table of memories.

Similarities are computed in one pass over the memories for each batch of queries (queries are few and
broadcast if Spark's own size check allows), and top-k keeps k rows for each query and task before
anything is shuffled: a local rank comes first, the global rank over what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, vectors
from memlake.operators import similarity
from memlake.sources.tables import cut

RRF_K = 60


def top_k(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows of each group.  Spark's group limit ranks within tasks before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def scored(memories: DataFrame, query: list[float], now: str, floor: float = scoring.FLOOR) -> DataFrame:
    """memories with similarity, score, ranking_score and relevance to one query vector."""
    at = F.lit(now).cast("timestamp")
    sim = vectors.cosine("embedding", vectors.literal(query))
    rec = scoring.recency(F.col("last_accessed_at"), at)
    imp, trust = F.col("importance").cast("double"), F.col("trust").cast("double")
    return memories.withColumn("similarity", sim).withColumn("score", scoring.score(F.col("similarity"), imp, rec, trust)).withColumn("ranking_score", scoring.ranking_score(F.col("similarity"), imp, rec, trust, floor)).withColumn("relevance", scoring.clamp(F.col("similarity")))


def vector_search(memories: DataFrame, query: list[float], k: int, now: str, floor: float = scoring.FLOOR) -> DataFrame:
    k = max(1, min(100, k))
    return top_k(scored(memories, query, now, floor), k, F.desc("ranking_score"), F.asc("id"))


def two_stage(memories: DataFrame, query: list[float], k: int, now: str, step: int = 6) -> DataFrame:
    """Shortlist by every step-th dimension, then exact scores for max(6k, 24) rows."""
    rough = vectors.cosine(vectors.subsample("embedding", step), vectors.literal(query[::step]))
    short = top_k(memories.withColumn("_rough", rough), max(6 * k, 24), F.desc("_rough"), F.asc("id")).drop("_rough")
    return vector_search(short, query, k, now)


def stems(text: Column) -> Column:
    """Distinct lower-case words without their commonest English endings."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "(ing|ed|es|s)$", "")))


def keyword_rank(text: Column, terms: list[str]) -> Column:
    """Occurrences of terms per word of the text, 1 at most; a documented stand-in for a full-text rank."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    wanted = F.array(*map(F.lit, terms))
    hits = F.size(F.filter(words, lambda w: F.array_contains(wanted, F.regexp_replace(w, "(ing|ed|es|s)$", ""))))
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.size(words)))


def by_words() -> list[Column]:
    """Order of keyword hits."""
    return [F.desc("rank_score"), F.desc("importance"), F.asc("id")]


def keyword_search(memories: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Rows that have all the (stemmed) terms."""
    has = F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(F.col("_stems"), t))
    hits = memories.withColumn("_stems", stems(F.col("content"))).where(has).drop("_stems").withColumn("rank_score", keyword_rank(F.col("content"), terms))
    return top_k(hits, k, *by_words())


def hybrid_search(memories: DataFrame, query: list[float], terms: list[str], k: int, now: str, lexical: float = 0.8, found: DataFrame | None = None) -> DataFrame:
    """Vector and keyword channels of 4k rows each, fused by reciprocal rank.

    found: the keyword channel's (id, rank_score, importance) of an index; without one, texts are searched.
    """
    near = vectors.cosine("embedding", vectors.literal(query)).alias("sim")
    rank = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  over 4k rows at most
    v = top_k(memories.select("id", near), 4 * k, F.desc("sim"), F.asc("id")).select("id", rank(F.desc("sim"), F.asc("id")).alias("vr"))
    words = keyword_search(memories, terms, 4 * k) if found is None else top_k(found, 4 * k, *by_words())
    f = words.select("id", rank(*by_words()).alias("fr"))
    fused = v.join(f, "id", "full_outer").withColumn("rrf", F.coalesce(1.0 / (RRF_K + F.col("vr")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("fr")), F.lit(0.0)))
    # Scores are for the fused rows only, 8k at most.
    out = scored(memories.join(F.broadcast(fused), "id"), query, now).withColumn("ranking_score", F.col("ranking_score") + lexical * F.col("rrf"))
    return top_k(out, k, F.desc("ranking_score"), F.asc("id"))


def fact_hybrid(facts: DataFrame, query: list[float], terms: list[str], k: int, found: DataFrame | None = None) -> DataFrame:
    """Child facts (fact_id, parent, content, embedding, importance) ranked, fused and rolled up to parents:
    best similarity, best fusion score, three best facts.  ``found`` as in ``hybrid_search``."""
    near = facts.withColumn("sim", vectors.cosine("embedding", vectors.literal(query)))
    rank = lambda *o: F.row_number().over(Window.orderBy(*o))
    v = top_k(near.select(F.col("fact_id").alias("id"), "sim"), 6 * k, F.desc("sim"), F.asc("id")).select("id", rank(F.desc("sim"), F.asc("id")).alias("vr"))
    words = keyword_search(facts.withColumnRenamed("fact_id", "id"), terms, 6 * k) if found is None else top_k(found, 6 * k, *by_words())
    f = words.select("id", rank(*by_words()).alias("fr"))
    fused = v.join(f, "id", "full_outer").withColumn("rrf", F.coalesce(1.0 / (RRF_K + F.col("vr")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("fr")), F.lit(0.0)))
    rows = facts.join(F.broadcast(fused), facts["fact_id"] == fused["id"]).select("parent", "fact_id", vectors.cosine("embedding", vectors.literal(query)).alias("sim"), "rrf")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-(F.col("sim") + F.col("rrf"))).alias("o"), "fact_id"))), 1, 3)
    return rows.groupBy("parent").agg(F.max("sim").alias("similarity"), F.max("rrf").alias("rrf"), F.transform(best, lambda x: x["fact_id"]).alias("facts"))


def hierarchical(memories: DataFrame, summaries: DataFrame, query: list[float], parents: int = 3, children: int = 10, most: int = 50) -> DataFrame:
    """Best conversations, best sessions in them, newest memories of those.

    summaries: (level, key, parent, embedding); memories: session key in ``topic``.
    """
    near = summaries.withColumn("sim", vectors.cosine("embedding", vectors.literal(query)))
    top = top_k(near.where("level = 0"), parents, F.desc("sim"), F.asc("key")).select(F.col("key").alias("parent"))
    mid = top_k(near.where("level = 1").join(top, "parent", "left_semi"), children, F.desc("sim"), F.asc("key")).select(F.col("key").alias("topic"))
    return top_k(memories.join(mid, "topic", "left_semi"), most, F.desc("created_at"), F.asc("id"))


def keyword_similarity(text: Column, keywords: list[str]) -> Column:
    """0.45 + 0.44 * matched weight / weight, 0.89 at most; phrases 2.5, acronyms and camel case 2, 8 letters 1.5, else 1."""
    import re

    def weight(w: str) -> float:
        if " " in w:
            return 2.5
        return 2.0 if re.search(r"^[A-Z0-9]{2,}$|[a-z][A-Z]", w) else 1.5 if len(w) >= 8 else 1.0

    total = sum(map(weight, keywords)) or 1.0
    got = sum((F.when(F.lower(text).contains(w.lower()), weight(w)).otherwise(0.0) for w in keywords), F.lit(0.0))
    return F.when(got > 0, F.least(F.lit(0.89), 0.45 + 0.44 * got / total)).otherwise(0.0)


def heuristic_rerank(rows: DataFrame, now: str) -> DataFrame:
    """Short texts up, very long ones down, fresh ones up a little; 1 at most."""
    n = F.length("content")
    fresh = scoring.seconds(F.lit(now).cast("timestamp"), F.col("created_at")) < 7 * 86400
    boosted = F.col("similarity") * F.when(n < 500, 1.1).when(n > 2000, 0.9).otherwise(1.0) * F.when(fresh, 1.05).otherwise(1.0)
    return rows.withColumn("reranked", F.least(F.lit(1.0), boosted))


def near_pairs(rows: DataFrame, threshold: float, block: str) -> DataFrame:
    """(a, b, similarity), a < b, of rows of one block whose cosine exceeds the threshold."""
    p = similarity.similar_pairs(rows.select("id", "embedding", block), threshold, block)
    return p.where(F.col("similarity") > threshold).withColumnRenamed("grp", block)


def sign_bands(rows: DataFrame, dim: int, bands: int = 16, bits: int = 8, seed: int = 13) -> DataFrame:
    """rows with codes: a sign-random-projection bucket for each band, for approximate candidate search."""
    import random

    r = random.Random(seed)
    planes = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(bands * bits)]
    codes = []
    for b in range(bands):
        signs = [F.when(vectors.dot("embedding", vectors.literal(p)) >= 0, 1 << j).otherwise(0) for j, p in enumerate(planes[b * bits : (b + 1) * bits])]
        codes.append(sum(signs[1:], signs[0]))
    return rows.withColumn("codes", F.array(*codes))


def candidates_by_bands(rows: DataFrame, queries: DataFrame, dim: int, threshold: float, block: int = similarity.FACING, **options) -> DataFrame:
    """(query_id, id, similarity): rows in a bucket of a query (query_id, embedding), verified by cosine.

    Rows and queries of a bucket meet in blocks; a pair counts in the first band in which it shares a bucket,
    so none is made twice, and only pairs above the threshold leave their task. Vectors of another length
    than ``dim`` have no candidates.
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")

    def placed(df: DataFrame, name: str) -> DataFrame:
        x = cut(sign_bands(df, dim, **options).select(name, "codes", similarity.unit("embedding").alias("v")).where(F.size("v") == dim))
        return x.select(name, "codes", "v", F.posexplode("codes").alias("band", "code")).select(F.struct("band", "code").alias("grp"), "band", name, "codes", "v")

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and r.num_rows:
            v, w, p, q, band = similarity.matrix(a["v"]), similarity.matrix(r["v"]), similarity.matrix(a["codes"]), similarity.matrix(r["codes"]), a["band"][0].as_py()
            for s in range(0, len(v), similarity.SLICE):
                i, j = np.nonzero(v[s : s + similarity.SLICE] @ w.T > threshold - 1e-9)
                for x in range(0, len(i), block):
                    one, other = i[x : x + block] + s, j[x : x + block]
                    # Products depend on a row's place in its block; these are alike for equal vectors.
                    exact = (v[one] * w[other]).sum(axis=1)
                    new = (exact > threshold) & ~(p[one, :band] == q[other, :band]).any(axis=1)
                    found.append((one[new], other[new], exact[new]))
        i, j, c = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, int) for n in range(3))
        return pa.table({"query_id": a["query_id"].take(pa.array(i, pa.int64())), "id": r["id"].take(pa.array(j, pa.int64())), "similarity": pa.array(c, pa.float64())})

    kind = dict(rows.dtypes)["id"]
    return similarity.facing(placed(queries, "query_id"), placed(rows, "id"), run, f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, similarity double", "query_id", "id", block)
