"""Exact joins on vector similarity, and ordered greedy selection on their edges.

``similar_pairs`` gives all pairs of a group with a cosine of at least a threshold, and none twice.  On
unit vectors that is a distance of at most r = sqrt(2 - 2 t), so pivots prune exactly: each vector is at
home in the cell of its nearest pivot, and visits another cell only if the hyperplane between the two
pivots is within r of it (triangle inequality).  A pair is looked for in the cell of the one whose home
has the smaller number.  Cells are compared in blocks of at most ``BLOCK`` rows, as matrix products, so a
task's work is bounded whatever a cell's or group's size; where pivots can't tell cells apart, by the
threshold or by what they save on a sample, there is one cell, and the blocks alone bound the work.

``greedy`` is the sequential rule "in order, each row that isn't taken opens a cluster with its free
neighbours, if they are enough" in rounds: a row decides once no undecided row within two steps is before
it in order.  Rows that decide in one round have no neighbour in common, so the result is that of the
sequence.  Each round is a few joins on the edges that are left; decided parts leave.

``facing`` deals two tables that meet by group into blocks of at most ``FACING`` rows of either, and
``nearest`` takes the best k of each block before anything is merged: what moves grows with the rows
times the blocks they meet, and no pair leaves its task unless it is among a block's best.

Scale: pivots are a sample of ``PIVOTS`` rows at most, chosen by hash, and broadcast; vectors move once
for their cell and once for each block they meet, and leave a task ``SENT`` at a time; rounds grow with the longest chain of rows that wait
for each other, not with rows.

Defined results: rows with a null vector, one of no length or of another length than most pivots' have
no pairs; equal vectors are a pair; repeated ids are not told apart; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.tables import cut

PIVOTS = 128
BLOCK = 512
#: Rows of either side in a block of ``facing``, and of one side in a matrix product.
FACING = 4096
SLICE = 512
#: Rows that are worth a further pivot.
ROWS_A_PIVOT = 32
#: Rows on which pivots are tried, and the share of all pairs that they may leave.
TRIED = 1024
LEFT = 0.5
#: Copies of rows in one batch that a task sends to cells.
SENT = 4096


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(rows: DataFrame, group: str, carry: str | None = None) -> tuple[DataFrame, int]:
    """(grp, id, v, x) at unit length, of the vectors of the length that most have; and that length."""
    v = F.col("embedding").cast("array<double>")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 0
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    u = rows.where(F.size("embedding") == dim).select(F.col(group).alias("grp"), "id", v.alias("v"), norm.alias("norm"), (F.col(carry).cast("double") if carry else F.lit(0.0)).alias("x")).where("norm > 0 AND norm < double('infinity')")
    return u.select("grp", "id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), "x"), dim


def _visits(vectors: np.ndarray, pivots: np.ndarray, apart: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and which cells it visits."""
    near = vectors @ pivots.T
    home = near.argmax(axis=1)
    # Distance to the hyperplane between pivots h and j is (cos_h - cos_j) / |h - j| for unit vectors.
    visits = near[np.arange(len(home)), home][:, None] - near <= (r + 1e-9) * apart[home]
    # Only cells of a smaller number: the pair is looked for there.
    return home, visits & (np.arange(len(pivots))[None, :] < home[:, None])


def _apart(pivots: np.ndarray) -> np.ndarray:
    return np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)


def left_by(pivots: np.ndarray, tried: np.ndarray, r: float) -> float:
    """The share of all pairs that the cells of the pivots leave to compare, on some vectors."""
    home, visits = _visits(tried, pivots, _apart(pivots), r)
    h, g = np.bincount(home, minlength=len(pivots)), visits.sum(axis=0)
    return float((h * (h / 2 + g)).sum() / (len(tried) ** 2 / 2))


def copies(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, r: float) -> Iterator[pa.RecordBatch]:
    """Batches (grp, id, v, x) as those of ``cells``, of about SENT rows at most."""
    apart = _apart(pivots)
    # A row has as many copies as there are pivots at most.
    rows = max(1, SENT // len(pivots))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            home, visits = _visits(matrix(b.column(2)), pivots, apart, r)
            row, cell = np.nonzero(visits)
            row, cell = np.concatenate([np.arange(len(home)), row]), np.concatenate([home, cell])
            at_home = np.arange(len(row)) < len(home)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(cell, pa.int32()), pa.array(at_home), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take)], names=["grp", "cell", "home", "id", "v", "x"])


def cells(units: DataFrame, pivots: np.ndarray, r: float) -> DataFrame:
    """(grp, cell, home, id, v, x): each row once at home and once for each other cell it visits."""
    types = dict(units.dtypes)
    run = lambda batches: copies(batches, pivots, r)
    return units.select("grp", "id", "v", "x").mapInArrow(run, f"grp {types['grp']}, cell int, home boolean, id {types['id']}, v array<double>, x double")


def similar_pairs(
    rows: DataFrame, threshold: float, group: str, pivots: int = PIVOTS, carry: str | None = None, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, least: float | None = None,
) -> DataFrame:
    """(grp, a, b, similarity), a < b: pairs of rows (id, embedding, group) with a cosine of at least the threshold.

    With ``score``, a function of (cosines, values of the column ``carry`` of one side, of the other), the
    similarity is the score, and pairs count from ``least`` on; ``threshold`` is the cosine they have at least.
    """
    units, dim = _units(rows, group, carry)
    least = threshold if least is None else least
    units = cut(units)
    types = dict(units.dtypes)
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    # Cells don't part anything once r reaches the usual distance of pivots.
    wanted = min(pivots, units.count() // ROWS_A_PIVOT) if r < 1 else 0
    chosen = units.orderBy(F.xxhash64("id"), "id").limit(wanted + TRIED).select("v").collect() if wanted > 1 else []
    sample = np.array([x["v"] for x in chosen], np.float64).reshape(len(chosen), dim)
    points = np.unique(sample[:wanted], axis=0)
    # Cells that leave most pairs to compare only cost copies.
    if len(points) > 1 and left_by(points, sample[wanted:], r) <= LEFT:
        placed = cut(cells(units, points, r))
    else:
        placed = units.select("grp", F.lit(0).alias("cell"), F.lit(True).alias("home"), "id", "v", "x")

    at = ["grp", "cell"]
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    sizes = placed.groupBy(*at).agg(F.ceil(F.count_if("home") / BLOCK).alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK).alias("guests"))
    y = placed.join(sizes.withColumnRenamed("grp", "_g").withColumnRenamed("cell", "_c"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_c"))).where("homes > 0")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = y.where("home").withColumn("p", part("homes"))
    # A home block meets itself, the home blocks after it, and every block of guests.
    left = mine.select(*at, F.col("p").alias("l"), F.explode(F.concat(F.transform(F.sequence("p", F.col("homes") - 1), lambda k: F.struct(F.lit(True).alias("h"), k.alias("k"))), F.transform(F.when(F.col("guests") > 0, upto("guests")).otherwise(F.array().cast("array<bigint>")), lambda k: F.struct(F.lit(False).alias("h"), k.alias("k"))))).alias("m"), F.lit(True).alias("first"), "id", "v", "x")
    later = mine.where("p > 0").select(*at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("l"), F.struct(F.lit(True).alias("h"), F.col("p").alias("k")).alias("m"), F.lit(False).alias("first"), "id", "v", "x")
    guests = y.where("NOT home").withColumn("p", part("guests")).select(*at, F.explode(upto("homes")).alias("l"), F.struct(F.lit(False).alias("h"), F.col("p").alias("k")).alias("m"), F.lit(False).alias("first"), "id", "v", "x")
    dealt = left.union(later).union(guests).select(*at, "l", F.col("m.h").alias("h"), F.col("m.k").alias("k"), "first", "id", "v", "x")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["first"]], pdf[~pdf["first"]]
        own = bool(pdf["h"].iloc[0]) and pdf["l"].iloc[0] == pdf["k"].iloc[0]
        b = a if own else b
        if not len(a) or not len(b):
            return pd.DataFrame({"grp": [], "a": [], "b": [], "similarity": []})
        sim = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        if score is not None:
            sim = score(sim, a["x"].to_numpy()[:, None], b["x"].to_numpy()[None, :])
        i, j = np.nonzero(sim >= least)
        if own:
            i, j = i[i < j], j[i < j]
        left, right = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        low = left < right
        keep = left != right
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": np.where(low, left, right)[keep], "b": np.where(low, right, left)[keep], "similarity": sim[i, j][keep]})

    return dealt.groupBy(*at, "l", "h", "k").applyInPandas(compare, f"grp {types['grp']}, a {types['id']}, b {types['id']}, similarity double")


def compared(rows: DataFrame, threshold: float, group: str, pivots: int = PIVOTS) -> int:
    """How many pairs of vectors the cells offer for comparison."""
    units, dim = _units(rows, group)
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    points = np.array([x["v"] for x in units.orderBy(F.xxhash64("id"), "id").limit(min(pivots, units.count() // ROWS_A_PIVOT)).select("v").collect()])
    n = cells(units, points, r).groupBy("grp", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    return int(n.agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("g"))).first()[0] or 0)


def facing(asked: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, asked_id: str = "id", row_id: str = "id", block: int = FACING, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """What ``run`` makes of each block of asked and each of rows that have the same ``grp``; null groups meet nothing.

    ``keep`` writes what is read more than once; callers that pass tables may leave them as they are.
    """

    def blocks(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).alias(n))

    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, should both be of one table
    asked, rows = keep(asked), keep(rows)
    sizes = keep(blocks(asked, "_ps").join(blocks(rows, "_qs"), "grp"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = asked.join(sizes, "grp").withColumn("_p", own(asked_id, "_ps")).withColumn("_q", every("_qs")).drop("_ps", "_qs")
    r = rows.join(sizes, "grp").withColumn("_q", own(row_id, "_qs")).withColumn("_p", every("_ps")).drop("_ps", "_qs")
    return a.groupBy("grp", "_p", "_q").cogroup(r.groupBy("grp", "_p", "_q")).applyInArrow(run, schema)


def unit(vector: str) -> Column:
    """The vector at unit length; null for one without a length."""
    v = F.col(vector).cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return {int(k): (at := np.nonzero(n == k)[0], matrix(a.take(pa.array(at)))) for k in np.unique(n) if k}


def best(i: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first k of each i; order: keys, the last one first, as lexsort has them."""
    o = np.lexsort((*order, i))
    first = np.r_[True, i[o][1:] != i[o][:-1]] if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0)) if len(o) else np.zeros(0, int)
    return o[np.arange(len(o)) - start < k]


def nearest(asked: DataFrame, rows: DataFrame, group: str, k: int, least: float | None = None, block: int = FACING) -> DataFrame:
    """(question_id, id, similarity): the k rows of each question's group with the largest cosine, ties to the smaller id.

    asked: (question_id, group, vector); rows: (id, group, embedding).  A cosine with a vector that is null,
    of no length or of another length is 0.  With ``least`` only cosines of at least that count.
    """
    a = asked.select(F.col(group).alias("grp"), "question_id", unit("vector").alias("v"))
    r = rows.select(F.col(group).alias("grp"), "id", unit("embedding").alias("v"))

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        left, right = _by_length(a["v"]), _by_length(r["v"])
        ranks = pc.rank(r["id"].combine_chunks(), "ascending", tiebreaker="first").to_numpy(zero_copy_only=False) if r.num_rows else np.zeros(0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Questions by the length of their vector; those without one have cosines of 0.
        without = np.setdiff1d(np.arange(a.num_rows), np.concatenate([at for at, _ in left.values()]) if left else [])
        for n, (at, m) in [*left.items(), (0, (without, np.zeros((len(without), 0))))]:
            facing_at, w = right.get(n, (np.zeros(0, int), np.zeros((0, m.shape[1]))))
            for s in range(0, len(at), SLICE):
                sim = np.zeros((len(at[s : s + SLICE]), r.num_rows))
                sim[:, facing_at] = m[s : s + SLICE] @ w.T
                high = np.full(len(sim), -np.inf if least is None else least)
                if sim.shape[1] > k:
                    high = np.maximum(high, np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k])
                i, j = np.nonzero(sim >= high[:, None] - 1e-9)
                # Products depend on a row's place in its block; those that count are made again, alike for equal vectors.
                place = np.full(r.num_rows, -1)
                place[facing_at] = np.arange(len(facing_at))
                exact = np.zeros(len(i))
                for x in range(0, len(i), FACING):
                    y = slice(x, x + FACING)
                    known = place[j[y]] >= 0
                    exact[y][known] = (m[s + i[y][known]] * w[place[j[y]][known]]).sum(axis=1)
                if least is not None:
                    i, j, exact = i[exact >= least], j[exact >= least], exact[exact >= least]
                o = best(i, (ranks[j], -exact), k)
                out.append((at[s + i[o]], j[o], exact[o]))
        i, j, x = (np.concatenate([y[c] for y in out]) if out else np.zeros(0, int) for c in range(3))
        return pa.table({"question_id": a["question_id"].take(pa.array(i, pa.int64())), "id": r["id"].take(pa.array(j, pa.int64())), "similarity": pa.array(x, pa.float64())})

    t = dict(a.dtypes) | {"id": dict(r.dtypes)["id"]}
    found = facing(a, r, run, f"question_id {t['question_id']}, id {t['id']}, similarity double", "question_id", "id", block)
    w = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def greedy(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """(id, centre): the clusters of the sequential rule; rows in none are missing.

    nodes: (id, ord), ord of any sortable type, unique.  edges: (a, b) without direction.  In order of
    ord each row that isn't taken takes its free neighbours, if it and they are at least ``least``.
    With a column ``todo``, rows where it is false open nothing and may be taken.
    """
    nodes = nodes if "todo" in nodes.columns else nodes.withColumn("todo", F.lit(True))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    ranked = both.join(nodes.select(F.col("id").alias("a"), F.col("ord").alias("oa"), F.col("todo").alias("todo_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("ord").alias("ob"), F.col("todo").alias("todo_b")), "b")
    # todo: free and undecided.  Decided rows that opened nothing stay in the graph, as others may take them.
    graph = cut(ranked.select("a", "b", "oa", "ob", "todo_a", "todo_b"))
    out = nodes.where("false").select("id", F.col("id").alias("centre"))
    while True:
        # The first undecided row among a node and its neighbours, then among those of its neighbours.
        one = graph.groupBy("a").agg(F.min(F.when(F.col("todo_b"), F.col("ob"))).alias("m"), F.first("oa").alias("oa"), F.first("todo_a").alias("todo"))
        one = one.select("a", "oa", "todo", F.least("m", F.when(F.col("todo"), F.col("oa"))).alias("m"))
        two = graph.join(one.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").groupBy("a").agg(F.min("mb").alias("mb"))
        acting = one.join(two, "a").where("todo").where(F.least("m", "mb") == F.col("oa")).select("a")
        acting = cut(acting)
        if acting.isEmpty():
            break
        stars = graph.join(acting, "a", "left_semi").select(F.col("a").alias("centre"), F.col("b").alias("id"))
        big = stars.groupBy("centre").agg((F.count(F.lit(1)) + 1 >= least).alias("opens"))
        big = cut(big)
        members = stars.join(big.where("opens").select("centre"), "centre", "left_semi").select("id", "centre")
        members = cut(members.union(big.where("opens").select(F.col("centre").alias("id"), "centre")))
        out = out.union(members)
        failed = big.where("NOT opens").select(F.col("centre").alias("x"))
        taken = members.select(F.col("id").alias("x"))
        left = graph.join(taken.withColumnRenamed("x", "a"), "a", "left_anti").join(taken.withColumnRenamed("x", "b"), "b", "left_anti")
        fa, fb = failed.select(F.col("x").alias("a"), F.lit(True).alias("fa")), failed.select(F.col("x").alias("b"), F.lit(True).alias("fb"))
        left = left.join(fa, "a", "left").join(fb, "b", "left")
        graph = left.select("a", "b", "oa", "ob", (F.col("todo_a") & F.col("fa").isNull()).alias("todo_a"), (F.col("todo_b") & F.col("fb").isNull()).alias("todo_b"))
        graph = cut(graph)
    if least <= 1:
        # Rows whose neighbours were all taken by others are on their own.
        out = out.union(nodes.where("todo").join(out.select("id"), "id", "left_anti").select("id", F.col("id").alias("centre")))
    return out
