"""Deduplication rules over result lists, facts and composites."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import graph, similarity
from memlake.sources.tables import cut


def fingerprint(text: Column) -> Column:
    """Lower-case letters and digits, the first 80."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), 1, 80)


def strip_as_of(text: Column) -> Column:
    """The text without a leading "As of ...,"."""
    return F.trim(F.regexp_replace(text, r"(?i)^\s*as of [^,]*,\s*", ""))


def first_of_fingerprint(rows: DataFrame, by: str, *order: Column, least: int = 3) -> DataFrame:
    """Keep the first of each fingerprint within a list; rows without one stay; a list left with too few is kept whole."""
    fp = fingerprint(F.col("content"))
    w = Window.partitionBy(by, "_fp").orderBy(*order)
    marked = rows.withColumn("_fp", fp).withColumn("_first", (F.row_number().over(w) == 1) | (F.col("_fp") == ""))
    left = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(by))
    return marked.withColumn("_left", left).where(F.col("_first") | (F.col("_left") < least)).drop("_fp", "_first", "_left")


def majority(runs: DataFrame, key: str, run: str, total: int) -> DataFrame:
    """Facts that at least half of the extraction runs found."""
    g = runs.groupBy(key).agg(F.countDistinct(run).alias("votes"))
    return g.where(F.col("votes") >= -(-total // 2))


def drop_covered(rows: DataFrame, composites: DataFrame) -> DataFrame:
    """Rows that are members of no composite of the list."""
    return rows.join(composites.select(F.explode("member_ids").alias("id")).distinct(), "id", "left_anti")


def soft_covered(rows: DataFrame, composites: DataFrame, share: float = 0.6) -> DataFrame:
    """Composites of which at least a share of the members is in the list: (composite_id, coverage)."""
    m = composites.select("composite_id", F.explode("member_ids").alias("id"))
    c = m.join(rows.select("id", F.lit(1).alias("_in")), "id", "left").groupBy("composite_id").agg((F.sum(F.coalesce("_in", F.lit(0))) / F.count(F.lit(1))).alias("coverage"))
    return c.where(F.col("coverage") >= share)


def fresh_composites(composites: DataFrame, active_ids: DataFrame) -> DataFrame:
    """Composites all of whose members are active."""
    gone = composites.select("composite_id", F.explode("member_ids").alias("id")).join(active_ids, "id", "left_anti").select("composite_id").distinct()
    return composites.join(gone, "composite_id", "left_anti")


def new_content(incoming: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Rows whose SHA-256 isn't known yet."""
    return incoming.withColumn("hash", F.sha2("content", 256)).join(known_hashes, "hash", "left_anti")


def last_wins(rows: DataFrame, order: str, *keys: Column) -> DataFrame:
    """For each key the last row's values, at the first row's place."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    g = rows.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max_by(F.struct(*rows.columns), order).alias("x"), F.min(order).alias("place"))
    return g.select("x.*", "place")


def ordered_facts(facts: DataFrame, by: str, threshold: float, keep_important: bool) -> DataFrame:
    """(by, id): drop facts too similar to one kept before them in order; or exchange it for the more important.

    Facts meet only those whose vectors are within the threshold, so a group falls into components of
    similar vectors.  A vector that is like no other is decided by an aggregate over its copies; the
    facts of each other component are folded in order, as a sorted stream of which a task holds the
    facts kept so far.  The fold is sequential by nature, within a component only.

    The threshold is above 0.  Facts without a vector, or with one of no length, all stay; an importance
    of null or NaN neither gives way nor takes a place; of equal ord the smaller id comes first.
    """
    v = F.col("embedding").cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    usable = F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    rows = cut(facts.select(F.col(by).alias("grp"), "id", "ord", "importance", v.alias("embedding"), usable.alias("usable"), F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2")))
    held, key = rows.where("usable"), ["grp", "h1", "h2"]
    vectors = cut(held.groupBy(*key).agg(F.first("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id()))
    lengths = [x["n"] for x in vectors.select(F.size("embedding").alias("n")).distinct().collect()]
    # A little below the threshold: the fold decides, with the same product as ever.
    near = [similarity.similar_pairs(vectors.where(F.size("embedding") == n), threshold - 1e-9, "grp").select("a", "b") for n in lengths]
    found = graph.components(functools.reduce(DataFrame.union, near)) if near else vectors.select(F.col("id").alias("node"), F.col("id").alias("component")).where("false")
    linked = vectors.join(found, vectors["id"] == found["node"]).select(*[F.col(c).alias(f"_{c}") for c in key], "component")
    placed = cut(held.join(linked, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left"))

    order = [F.col("ord").isNull().alias("last"), F.col("ord"), F.col("id")]
    known = F.col("importance").isNotNull() & ~F.isnan(F.col("importance").cast("double"))
    first = F.min(F.struct(*order, known.alias("known")))
    chosen = F.min(F.when(known, F.struct((-F.col("importance")).alias("low"), *order)))
    alone = placed.where("component IS NULL").groupBy(*key).agg(first.alias("first"), chosen.alias("best"))
    one = F.when(F.col("first.known"), F.col("best.id")).otherwise(F.col("first.id")) if keep_important else F.col("first.id")
    alone = alone.select("grp", one.alias("id"))

    t = dict(rows.dtypes)
    together = placed.where("component IS NOT NULL").repartition("component").sortWithinPartitions("component", *order, F.desc("importance"), "h1", "h2")
    folded = together.select("component", "grp", "id", F.col("importance").cast("double").alias("importance"), "embedding").mapInArrow(lambda batches: _fold(batches, threshold, keep_important), f"grp {t['grp']}, id {t['id']}")
    out = alone.union(folded).union(rows.where("NOT usable").select("grp", "id"))
    return out.select(F.col("grp").alias(by), "id")


def _fold(batches: Iterator[pa.RecordBatch], threshold: float, keep_important: bool) -> Iterator[pa.RecordBatch]:
    """(grp, id) of the facts kept, of batches (component, grp, id, importance, embedding) sorted by component and order."""

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], schema.field(c + 1).type) for c in range(2)], names=["grp", "id"])

    # Kept facts are (grp, id) as values, so that they don't hold the batches they came in.
    component, kept, units, worth, schema = None, [], np.zeros((0, 0)), [], None
    for b in batches:
        schema = b.schema
        components = b.column(0).to_numpy(zero_copy_only=False)
        importance = pc.fill_null(b.column(3), float("nan")).to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            e = b.column(4)[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
            e = e / np.maximum(np.linalg.norm(e[None, :], axis=1), 1e-12)
            if components[i] != component:
                if kept:
                    yield batch(kept, schema)
                component, kept, units, worth = components[i], [], np.zeros((16, len(e))), []
            near = np.nonzero(units[: len(kept)] @ e >= threshold - 1e-9)[0]
            hit = next((k for k in near if e @ units[k] >= threshold), None)
            if hit is None:
                if len(kept) == len(units):
                    units = np.concatenate([units, np.zeros_like(units)])
                hit = len(kept)
                kept.append((b.column(1)[i].as_py(), b.column(2)[i].as_py()))
                worth.append(importance[i])
            elif keep_important and importance[i] > worth[hit]:
                kept[hit], worth[hit] = (b.column(1)[i].as_py(), b.column(2)[i].as_py()), importance[i]
            else:
                continue
            units[hit] = e
    if kept:
        yield batch(kept, schema)
