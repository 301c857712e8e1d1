"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.sources.tables import cut


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst, ...) with every undirected edge in both directions: makes OR-joins equi-joins."""
    rest = [c for c in edges.columns if c not in (a, b)]
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *rest)
    return one.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *rest))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop from seeds (node): distinct (node), seeds excluded."""
    hop = edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return hop.join(seeds, "node", "left_anti")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Edges both of whose ends are within ``hops`` of the seeds."""
    near = seeds.select("node")
    for _ in range(hops):
        near = near.union(neighbours(edges, near)).distinct()
    inside = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi")
    return inside.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 20, tolerance: float = 1e-6, hops: int = 2, cut_every: int = 5) -> DataFrame:
    """Personalised PageRank (node, rank) of the nodes within ``hops`` of the seeds (node, weight), without the seeds.

    Each round is a join with the edge table and one sum; dangling mass is lost.  Every few rounds the
    ranks are written to the checkpoint folder, which cuts their lineage, and compared with those of
    the round before; a sum of changes below the tolerance ends the loop.
    """
    near = cut(subgraph(edges, seeds.select("node"), hops).distinct())
    total = seeds.agg(F.sum("weight").alias("t"))
    start = seeds.crossJoin(F.broadcast(total)).select("node", (F.col("weight") / F.col("t")).alias("p"))  # one row
    out = cut(near.join(near.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"))
    rank = start.select("node", F.col("p").alias("rank"))
    again = start.select("node", ((1 - damping) * F.col("p")).alias("rank"))
    for k in range(rounds):
        before = rank
        flow = out.join(rank, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (damping * F.col("rank") / F.col("degree")).alias("rank"))
        rank = flow.unionByName(again).groupBy("node").agg(F.sum("rank").alias("rank"))
        if k % cut_every == cut_every - 1:
            rank = cut(rank)
            change = rank.join(before.withColumnRenamed("rank", "old"), "node", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("x")).first()["x"]
            if (change or 0.0) < tolerance:
                break
    return rank.join(seeds.select("node"), "node", "left_anti")


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.7) -> DataFrame:
    """Activation: a node gets its best neighbour's activation times decay, over ``hops`` hops."""
    level = seeds.select("node", F.col("weight").alias("activation"))
    for _ in range(hops):
        step = edges.join(level, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (decay * F.col("activation")).alias("activation"))
        level = level.unionByName(step).groupBy("node").agg(F.max("activation").alias("activation"))
    return level


def belief(edges: DataFrame) -> DataFrame:
    """(target, evidence, counter, net): summed weights by type, net within -1 and 1."""
    e = F.sum(F.when(F.col("edge_type") == "evidence_for", F.col("weight")).otherwise(0.0))
    c = F.sum(F.when(F.col("edge_type") == "counter", F.abs("weight")).otherwise(0.0))
    out = edges.groupBy("target").agg(e.alias("evidence"), c.alias("counter"))
    return out.withColumn("net", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("evidence") - F.col("counter"))))


def counter_evidence(edges: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """Newest edges into candidates from nodes that are no candidates: (src, dst, at), cap for each candidate."""
    from memlake.operators.search import top_k

    into = edges.join(candidates.select(F.col("id").alias("dst")), "dst", "left_semi").join(candidates.select(F.col("id").alias("src")), "src", "left_anti")
    return top_k(into, cap, F.desc("at"), F.asc("src"), by=("dst",))


def unordered_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b) to another; a component is named by its smallest node.

    Large-star and small-star steps in turn: joins of the edges with one minimum per node, so no
    neighbour list is gathered anywhere.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    ends = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
