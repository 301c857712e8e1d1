"""Mixing sources to target weights by weighted fair queueing (operator 1).

Every source is a queue of its documents in a fixed pseudo-random order, repeated up to
``max_repeats`` times.  A copy's virtual finish time is its source's cumulative tokens through it
divided by the source's weight; the mix is all copies in order of finish time, cut at the budget.

Scale: only (id, source, order key, size) rows move, never texts.  A cumulative sum within a source is
taken in 1024 slices of the order key, so that a source with a third of all rows is 1024 parallel
pieces; the global order is taken in 1024 equal ranges of virtual time, in which every source emits
tokens at its weight's rate, so ranges are even.  What is broadcast are the 1024 range offsets.  The
table of sources (names and weights, a configuration) is solved in one task.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source
of its own, after all others; equal rows are separate entries that follow each other; with no words
at all every target is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import NOT_WS, Scratch, as_row, documents, told

SLICES = 1024
RANGES = 1024
MAX_REPEATS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS + "+")), F.lit(0)).cast("long")


def order_key(id_col: Column) -> Column:
    """60 pseudo-random bits of the id; the same on every run and in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """(key, source, source_size) -> weight 1, 2, 3, 1, ... by code point of the source, null last."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1)


def solve_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add (budget, horizon, target): each source's share of all tokens by weight, at most
    ``max_repeats`` times its size, the excess shared again by weight.

    That fixed point is target = least(weight * horizon, max_repeats * size) for the one horizon at
    which targets sum to the budget; sources fill up in order of max_repeats * size / weight.
    """
    everything = Window.partitionBy()
    fill = (F.lit(float(max_repeats)) * F.col("source_size")) / F.col("weight")
    by_fill = Window.orderBy("fill", "key")
    t = (
        sources.withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("fill", fill)
        .withColumn("full_before", F.coalesce(F.sum(max_repeats * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full_before")).cast("double") / F.col("weight_left"))
    )
    t = t.withColumn("horizon", F.coalesce(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "key", "level"))).over(everything)["level"], F.lit(0.0)))
    target = F.least(F.col("weight") * F.col("horizon"), F.lit(float(max_repeats)) * F.col("source_size"))
    return t.withColumn("target", target).drop("fill", "full_before", "weight_left", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        weigh=cyclic_weights, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Return (entries, schedule).

    entries: one row for each document: entry columns (key, cum, id, source, size, source_size, weight, target, budget,
    horizon).  schedule: one row for each copy that may be taken: the entry, epoch, finish, start
    (tokens of the mix before it) and taken (whether the copy ends within the budget).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    source = F.col(source_col)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        order_key(F.col(id_col)).alias("ord"),
        (words(F.col("text")) if size is None else size).alias("size"),
    )
    narrow = scratch.keep(narrow.withColumn("slice", F.shiftright("ord", 60 - (SLICES.bit_length() - 1))), "narrow")

    slices = scratch.keep(narrow.groupBy("key", "slice").agg(F.min("source").alias("source"), F.sum("size").alias("slice_size")), "slices")
    sources = slices.groupBy("key").agg(F.min("source").alias("source"), F.sum("slice_size").alias("source_size"))
    sources = scratch.keep(solve_targets(weigh(sources), max_repeats), "sources")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    offsets = scratch.keep(offsets.join(sources.drop("source"), "key"), "offsets")

    within = Window.partitionBy("key", "slice").orderBy("ord", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    entries = narrow.join(offsets, ["key", "slice"]).withColumn("cum", F.col("offset") + F.sum("size").over(within))
    entries = scratch.keep(entries.drop("slice", "offset", "ord"), "entries")

    copies = (
        entries.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("cum")) / F.col("weight"))
        .where((F.col("epoch") * F.col("source_size") + F.col("cum") - F.col("size")) / F.col("weight") < F.col("horizon"))
        .withColumn("range", F.least(F.floor(F.col("finish") / F.col("horizon") * RANGES), F.lit(RANGES)).cast("int"))
    )
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    ranges = scratch.keep(ranges.select("range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("range_start")), "ranges")
    sort = Window.partitionBy("range").orderBy("finish", "key", "cum", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    schedule = copies.join(F.broadcast(ranges), "range").withColumn("start", F.col("range_start") + F.sum("size").over(sort) - F.col("size"))
    schedule = schedule.withColumn("taken", F.col("start") + F.col("size") <= F.col("budget")).drop("range_start")
    return entries, schedule


def taken_sizes(entries: DataFrame, schedule: DataFrame) -> DataFrame:
    """For each entry, tokens the mix takes of it and in how many copies."""
    cols = ["id", "key", "source", "size", "source_size", "weight", "target"]
    # (key, cum) is one entry: cum grows strictly over entries with a size.
    counted = schedule.where("taken").select(*cols, "cum", F.lit(1).alias("n"))
    rest = entries.select(*cols, "cum", F.lit(0).alias("n"))
    some = counted.union(rest.where("size > 0")).groupBy(*cols, "cum").agg(F.sum("n").alias("copies"))
    out = some.select(*cols, "copies").union(rest.where("size = 0").select(*cols, F.lit(0).cast("long")))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the input's columns.

    Documents are looked up by id and size, so ids are expected to be distinct; a null id is a value.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    per = scratch.keep(taken_sizes(*mix(docs, id_col=id_col, **options)).select("id", "size", "source", "copies"), "per")
    # Where one row has an id, the id settles it and the text stays where it is.
    by_id = per.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("copies")).alias("n"))
    # The row is a struct, so the schedule's columns clash with none of it.
    left = docs.select(as_row(docs).alias("row"), docs[id_col].alias("id"), docs["text"].alias("text"), docs["source"].alias("source"))
    sure, others = told(left, "id", scratch.keep(by_id, "by_id"), options.get("max_repeats", MAX_REPEATS))
    per = per.where("copies > 0").dropDuplicates(["id", "size", "source"])
    left = others.withColumn("size", words(F.col("text")))
    on = left["id"].eqNullSafe(per["id"]) & (left["size"] == per["size"]) & left["source"].eqNullSafe(per["source"])
    out = sure.select("row", F.col("_n").cast("long").alias("copies")).union(left.join(per, on).select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = taken_sizes(*mix(documents(spark, sf_dir)))
    return per.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS budget, (3.0::DOUBLE * source_size) / weight AS fill,
         coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left
  FROM s WINDOW o AS (ORDER BY (3.0::DOUBLE * source_size) / weight, coalesce('s' || source, 'n'))),
h AS (
  SELECT arg_min((budget - full_before)::DOUBLE / weight_left, fill) AS horizon
  FROM f WHERE (budget - full_before)::DOUBLE / weight_left <= fill),
t AS (
  SELECT source, source_size, weight, budget, coalesce(horizon, 0) AS horizon,
         least(weight * coalesce(horizon, 0), 3.0::DOUBLE * source_size) AS target
  FROM f, h),
e AS (
  SELECT d.doc_id, d.size, t.*, coalesce('s' || d.source, 'n') AS key,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (epoch * source_size + cum)::DOUBLE / weight AS finish
  FROM e, (SELECT unnest([0, 1, 2]) AS epoch)
  WHERE size > 0 AND (epoch * source_size + cum - size)::DOUBLE / weight < horizon),
r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, cum, epoch ROWS UNBOUNDED PRECEDING) AS running FROM c),
k AS (
  SELECT key, cum, count(*) AS copies FROM r WHERE running <= budget GROUP BY key, cum)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM e LEFT JOIN k ON e.key = k.key AND e.cum = k.cum AND e.size > 0
"""
