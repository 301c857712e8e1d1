"""Retrieval profiles, and a search that strings the operators together by one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import fusion, ranking, search


@dataclass(frozen=True)
class Profile:
    name: str
    results: int
    hybrid: bool
    lexical: float
    mmr: bool
    mmr_lambda: float
    links: int
    link_similarity: float
    rerank_depth: int
    floor: float
    repair_similarity: float
    repair_weight: float


# Fixed values.
PROFILES = {
    p.name: p
    for p in (
        Profile("safe", 5, False, 0.4, False, 0.7, 0, 0.5, 5, 0.35, 0.8, 0.0),
        Profile("balanced", 12, False, 0.8, True, 0.85, 3, 0.5, 16, 0.3, 0.72, 0.92),
        Profile("quality", 12, True, 1.15, True, 0.6, 4, 0.45, 12, 0.25, 0.78, 1.05),
    )
}


def profile(name: str | None = None, **changes) -> Profile:
    """A profile by name (balanced if none is given), with single settings changed."""
    if name is not None and name not in PROFILES:
        raise ValueError(f"no profile is named {name}: {', '.join(PROFILES)}")
    return replace(PROFILES[name or "balanced"], **changes)


def retrieve(memories: DataFrame, query: list[float], terms: list[str], now: str, how: Profile, links: DataFrame | None = None, question: str | None = None) -> DataFrame:
    """(id, score, source, place): search, eligibility, subject ranking, diversity and link expansion, as the profile says.

    memories as ``search.scored`` takes them; links: (src, dst, similarity).  Whatever follows the search
    works on at most ``rerank_depth`` rows.
    """
    depth = max(how.results, how.rerank_depth)
    if how.hybrid and terms:
        found = search.hybrid_search(memories, query, terms, depth, now, how.lexical)
    else:
        found = search.vector_search(memories, query, depth, now, how.floor)
    found = found.where(F.col("similarity") >= how.floor).withColumn("score", F.col("ranking_score")).withColumn("query_id", F.lit(0))
    if question:
        found = ranking.by_subject(found, question, F.col("content"), F.col("score"))
    if how.mmr:
        picked = fusion.mmr(found, how.results, how.mmr_lambda)
        found = found.join(picked.select("id", "pick"), "id").withColumn("place", F.col("pick"))
    else:
        found = search.top_k(found, how.results, F.desc("score"), F.asc("id"))
        found = found.withColumn("place", F.row_number().over(ranking.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    kept = found.select("query_id", "id", F.col("score").cast("double").alias("score"), "place")
    if not how.links or links is None:
        return kept.select("id", "score", F.lit("search").alias("source"), "place")
    near = links.where(F.col("similarity") >= how.link_similarity).select("src", "dst", F.col("similarity").cast("double").alias("score"))
    none = kept.where("FALSE").select("query_id", "id", "score")
    out = ranking.expand_by_links(kept, near, none, "query_id", how.links)
    return out.join(kept.select("id", "place"), "id", "left").select("id", "score", "source", "place")
