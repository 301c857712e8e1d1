"""Greedy clustering: stars by exact comparisons in batches; centroids within one episode are numpy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.search import top_k
from memlake.operators.similarity import SLICE, facing, matrix, unit
from memlake.sources.tables import Kept

#: Rows of a group that have their turn in the first batch, and at most in a later one.
BATCH, MOST = 512, 2048
#: Near rows of a candidate that its turn is decided on, where there are more.
WITNESSES = 8
#: What a block finds: near rows of a candidate; one of them, with the earlier candidates near it; a candidate's near candidates.
DEGREE, WITNESS, OWN = 0, 1, 2
FOUND = pa.schema([("grp", pa.string()), ("kind", pa.int32()), ("turn", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    e = np.array(pdf["embedding"].tolist(), np.float64).reshape(len(pdf), -1)
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def _turns(found: pa.Table, least: int) -> list[tuple[int, bool]]:
    """(turn, opens) of a group's candidates in order, up to the first that the witnesses don't decide."""
    kind, turn, n = (found[c].to_numpy() for c in ("kind", "turn", "n"))
    bits = [int.from_bytes(x.as_py() or b"", "little") for x in found["bits"]]
    m = int((kind == OWN).sum())
    degree, near, seen = [0] * m, [0] * m, [[] for _ in range(m)]
    for k, t, c, b in zip(kind, turn, n, bits, strict=True):
        if k == DEGREE:
            degree[t] += int(c)
        elif k == OWN:
            near[t] = b
        else:
            seen[t].append(b)
    facing_me = [[j for j in range(m) if near[j] >> i & 1] for i in range(m)]
    opened, gone, out = 0, [False] * m, []
    for i in range(m):
        if gone[i]:
            out.append((i, False))
            continue
        own = [j for j in facing_me[i] if not gone[j]]
        if len(own) + sum(not x & opened for x in seen[i]) + 1 >= least:
            opened |= 1 << i
            for j in [i, *own]:
                gone[j] = True
            out.append((i, True))
        elif degree[i] <= len(seen[i]):
            out.append((i, False))
        else:
            break
    return out


def affinity_clusters(rows: DataFrame, by: str, threshold: float = 0.85, beta: float = 0.5, rate: float = 0.1, least: int = 3, batch: int = BATCH) -> DataFrame:
    """Greedy stars by importance: beta * cosine + (1 - beta) * exp(-rate * hours) at least the threshold.

    rows: (by, id, importance, created_at, embedding) -> (by, cluster, id, affinity), affinity the mean to the centre.
    The sequence is kept in batches of each group's first ``batch`` rows that haven't had their turn, the candidates,
    later of up to ``MOST``.  All free rows meet them in blocks, and a block sends on what the turns need: the near
    candidates of each candidate, and for each a few near rows (witnesses) that the fewest earlier ones may take.  One
    task goes through a group's turns on those, of bounded size; a candidate that has more near rows than witnesses, none
    of which is sure to be free, waits with all after it for the next batch, where it comes first.  Then each free row
    goes to the first of its group's new centres that it is near.  No pair is written, and only one batch is on disk.
    """

    kept = Kept(rows.sparkSession)
    names = kept.keep(rows.select(by, "id"))
    known = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("grp"), "id", unit("embedding").alias("v"), (F.unix_micros(F.col("created_at").cast("timestamp_ltz")) / 3.6e9).alias("x"),
        F.struct(-F.coalesce("importance", F.lit(0)).cast("double"), "id").alias("ord"), F.lit(True).alias("todo"),
    ).where("v IS NOT NULL")
    known = kept.keep(known)
    lengths = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    # Vectors of another length than most have no pairs.
    free = kept.keep(known.where(F.size("v") == (lengths["n"] if lengths else 0)))
    kept.drop(known)
    types = dict(free.dtypes)
    witnesses = max(WITNESSES, least - 1)

    def similarities(a: pa.Table, r: pa.Table) -> np.ndarray:
        """Of candidates by turn and rows by id; in order, so that products of the same rows come out alike."""
        v, w, x, y = matrix(a["v"]), matrix(r["v"]), a["x"].to_numpy(), r["x"].to_numpy()
        sim = np.full((len(v), len(w)), -np.inf)
        for s in range(0, len(v), SLICE):
            sim[s : s + SLICE] = beta * (v[s : s + SLICE] @ w.T) + (1 - beta) * np.exp(-rate * np.abs(x[s : s + SLICE, None] - y[None, :]))
        # A row is not near itself, in whatever block it is.
        own = pc.index_in(r["id"], a["id"].combine_chunks()).to_numpy(zero_copy_only=False)
        at = np.nonzero(~np.isnan(own.astype(float)))[0]
        sim[own[at].astype(int), at] = -np.inf
        return sim

    def look(a: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple[str, int, int, int, bytes | None]] = []
        if a.num_rows and r.num_rows:
            a, r = a.sort_by("turn"), r.sort_by("id")
            grp, near = a["grp"][0].as_py(), similarities(a, r) >= threshold
            turn_of = {x: i for i, x in enumerate(a["id"].to_pylist())}
            own = np.array([turn_of.get(x, -1) for x in r["id"].to_pylist()])
            packed = np.packbits(near, axis=0, bitorder="little").T
            out += [(grp, OWN, int(own[j]), 0, packed[j].tobytes()) for j in np.nonzero(own >= 0)[0]]
            before = np.cumsum(near, axis=0, dtype=np.int32) - near
            for i in range(len(near)):
                j = np.nonzero(near[i] & (own < 0))[0]
                if len(j):
                    out.append((grp, DEGREE, i, len(j), None))
                    # Only candidates before this one can take the row before it.
                    for k in j[np.argsort(before[i, j], kind="stable")[:witnesses]]:
                        out.append((grp, WITNESS, i, int(before[i, k]), (int.from_bytes(packed[k].tobytes(), "little") & ((1 << i) - 1)).to_bytes((i + 7) // 8, "little")))
        return pa.Table.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in out], FOUND)

    def decide(found: pa.Table) -> pa.Table:
        turns = _turns(found, least)
        return pa.table({"grp": pa.array([found["grp"][0].as_py()] * len(turns), pa.string()), "turn": pa.array([t for t, _ in turns], pa.int32()), "opens": pa.array([o for _, o in turns], pa.bool_())})

    def take(a: pa.Table, r: pa.Table) -> pa.Table:
        i, j, sim = np.zeros(0, int), np.zeros(0, int), np.zeros((1, 1))
        if a.num_rows and r.num_rows:
            a, r = a.sort_by("turn"), r.sort_by("id")
            sim = similarities(a, r)
            opens = a["opens"].to_numpy(zero_copy_only=False)
            near = (sim >= threshold) & opens[:, None]
            centres = pc.is_in(r["id"], pc.filter(a["id"], a["opens"]).combine_chunks()).to_numpy(zero_copy_only=False)
            j = np.nonzero(near.any(axis=0) & ~centres)[0]
            i = near[:, j].argmax(axis=0)
        return pa.table({"id": r["id"].take(pa.array(j, pa.int64())), "centre": a["id"].take(pa.array(i, pa.int64())), "similarity": pa.array(sim[i, j], pa.float64())})

    parts, size = [], batch
    while True:
        first = top_k(free.where("todo").select("grp", "id", "v", "x", "ord"), size, F.asc("ord"), by=("grp",))
        first = kept.keep(first.select("grp", "id", "v", "x", (F.row_number().over(Window.partitionBy("grp").orderBy("ord")) - 1).alias("turn")))
        if first.isEmpty():
            break
        still = free.select("grp", "id", "v", "x")
        found = kept.keep(facing(first, still, look, "grp string, kind int, turn int, n long, bits binary", keep=lambda df: df))
        few = top_k(found.where(F.col("kind") == WITNESS), witnesses, F.asc("n"), F.asc("bits"), by=("grp", "turn")).select(found.columns)
        turns = kept.keep(few.union(found.where(F.col("kind") != WITNESS)).groupBy("grp").applyInArrow(decide, "grp string, turn int, opens boolean"))
        decided = kept.keep(first.join(turns, ["grp", "turn"], "left").select("grp", "id", "v", "x", "turn", F.coalesce("opens", F.lit(False)).alias("opens"), F.col("opens").isNotNull().alias("had")))
        taken = facing(decided.drop("had"), still, take, f"id {types['id']}, centre {types['id']}, similarity double", keep=lambda df: df)
        stars = kept.keep(taken.union(decided.where("opens").select("id", F.col("id").alias("centre"), F.lit(None).cast("double"))))
        mean = stars.groupBy("centre").agg(F.round(F.avg("similarity"), 6).alias("affinity")).where("affinity IS NOT NULL")
        parts.append(kept.keep(stars.join(mean, "centre").join(names, "id").select(by, F.col("centre").alias("cluster"), "id", "affinity")))
        had = decided.where("had").select("id", F.lit(True).alias("now"))
        left = free.join(stars.select("id"), "id", "left_anti").join(had, "id", "left")
        before, free = free, kept.keep(left.withColumn("todo", F.col("todo") & F.col("now").isNull()).select(free.columns))
        kept.drop(before, first, found, turns, decided, stars)
        size = min(4 * size, max(MOST, size))
    none = names.where("false").select(by, F.col("id").alias("cluster"), "id", F.lit(0.0).alias("affinity"))
    return reduce(DataFrame.union, parts, none)


def leader_clusters(rows: DataFrame, by: list[str], threshold: float = 0.55, most: int = 3) -> DataFrame:
    """Join the best centroid of at least the threshold that has room, else start a group; (by..., grp, members, content, importance)."""

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        e = _unit(pdf)
        groups: list[list[int]] = []
        for i in range(len(pdf)):
            best, at = -1.0, None
            for g, members in enumerate(groups):
                if len(members) < most:
                    c = e[members].mean(axis=0)
                    sim = float(c @ e[i] / max(np.linalg.norm(c), 1e-12))
                    if sim >= threshold and sim > best:
                        best, at = sim, g
            if at is None:
                groups.append([i])
            else:
                groups[at].append(i)
        out = []
        for g, members in enumerate(groups):
            if len(members) > 1:
                m = pdf.loc[members].sort_values(["importance", "id"], ascending=[False, True])
                out.append([*[pdf[b][0] for b in by], g, m["id"].tolist(), " ".join(m["content"]), float(m["importance"].max())])
        return pd.DataFrame(out, columns=[*by, "grp", "members", "content", "importance"])

    t = dict(rows.dtypes)
    schema = ", ".join(f"{b} {t[b]}" for b in by) + f", grp int, members array<{t['id']}>, content string, importance double"
    return rows.select(*by, "id", "content", "importance", "embedding").groupBy(*by).applyInPandas(lead, schema)
