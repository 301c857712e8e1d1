"""Temporal operators: as-of, chains, neighbours in time, interval closing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.tables import cut


def as_of(versions: DataFrame, at: str, keys: tuple[str, ...]) -> DataFrame:
    """For each key the latest version that is valid at a time (from <= at < to)."""
    t = F.lit(at).cast("timestamp_ntz")
    valid = versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("version_id"))
    return valid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str) -> DataFrame:
    """Each left row with the latest right row of its key that is not later: union, sort within key, carry forward."""
    cols = [c for c in right.columns if c not in (key, right_at)]
    a = left.select("*", F.lit(None).cast(right.select(F.struct(right_at, *cols)).dtypes[0][1]).alias("_r"), F.col(left_at).alias("_t"), F.lit(1).alias("_o"))
    b = right.select(key, F.struct(right_at, *cols).alias("_r"), F.col(right_at).alias("_t"), F.lit(0).alias("_o"))
    w = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    return both.where("_o = 1").select(*left.columns, F.col(f"_m.{right_at}").alias(right_at), *[F.col(f"_m.{c}").alias(c) for c in cols])


def neighbours_in_time(rows: DataFrame, anchors: DataFrame, minutes: int) -> DataFrame:
    """Rows within some minutes of any anchor (anchor_at), anchors' own ids excluded: bins make it an equi-join."""
    width = minutes * 60
    bin_ = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    a = anchors.select(F.col("id").alias("anchor_id"), "anchor_at", F.explode(F.array(*[bin_("anchor_at") + k for k in (-1, 0, 1)])).alias("bin"))
    near = F.abs(F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("anchor_at").cast("timestamp"))) <= width * 1_000_000
    hit = rows.withColumn("bin", bin_("created_at")).join(a, "bin").where(near).select("id").distinct()
    return rows.join(hit, "id", "left_semi").join(anchors.select("id"), "id", "left_anti")


def places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with idx, their place in their group from 0, and n, the group's size, without a window over a group.

    Rows are range-partitioned by group and order and numbered by the engine within partitions; one row
    for each (group, partition) turns that into places.  A group of any size is many tasks.
    """
    keys = [*group, *order]
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = cut(numbered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = numbered.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_rows").over(w).alias("n"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return numbered.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "n")


def running(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with ``out``, the sum of ``value`` over the rows of their group before them, without a window over a group.

    Sums of (group, partition) are added up from one row each, those within a partition by a window over it.
    """
    keys = [*group, *order]
    dealt = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*group)
    parts = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(out))


def inversions(rows: DataFrame, group: str, one: list[str], other: list[str]) -> DataFrame:
    """(group, inversions): pairs of rows that two orders put the other way round; ties of the second aren't any.

    ``one`` must be a total order.  A row's place in the second order is a number; two places differ first
    at some bit, and they are inverted if the one with that bit set comes first.  So for each bit, rows are
    counted that come before a row without it, have it, and agree above it: one running sum a bit, no pairs.
    """
    placed = places(rows.select(group, *dict.fromkeys([*one, *other])), [group], [*other, *[c for c in one if c not in other]])
    placed = places(placed.withColumnRenamed("idx", "_v").withColumnRenamed("n", "_n"), [group], one)
    placed = cut(placed.select(group, "_v", F.col("idx").alias("_at"), "_n"))
    most = placed.agg(F.max("_n")).first()[0] or 1
    out = placed.select(group, F.lit(0).cast("long").alias("k"))
    for bit in range((most - 1).bit_length()):
        x = placed.select(group, F.shiftright("_v", bit + 1).alias("_above"), F.shiftright("_v", bit).bitwiseAND(1).alias("_bit"), "_at")
        ones = running(x, [group, "_above"], ["_at"], "_bit", "k")
        out = out.union(ones.where("_bit = 0").select(group, "k"))
    return out.groupBy(group).agg(F.sum("k").alias("inversions"))


def upper_median(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """(group, out): the value in the middle of each group, of two the larger; nulls come last."""
    order = F.struct(F.col(value).isNull().alias("none"), F.col(value).alias("value"))
    placed = places(rows.select(group, order.alias("_o")), [group], ["_o"])
    return placed.where(F.col("idx") == F.floor(F.col("n") / 2)).select(group, F.col("_o.value").alias(out))


#: Words that a chain isn't named by (fixed values).
CHAIN_STOP = ("the", "a", "an", "i", "my", "your", "user", "is", "was", "has", "have", "to", "of", "in", "on", "at", "for", "and", "or", "it", "this", "that")


def chain_key(key: str, content: str) -> Column:
    """What a row's chain is named by: its key, else its first word of three letters or more."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+")
    first = F.get(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*CHAIN_STOP)), 0)
    return F.coalesce(key, first, F.lit("__unknown__"))


def chain(rows: DataFrame, entity: str, *order: str) -> DataFrame:
    """Position in the entity's chain, from 0, and the row before."""
    w = Window.partitionBy(entity).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w) - 1).withColumn("predecessor", F.lag("id").over(w))


def append_to_chain(stored: DataFrame, fresh: DataFrame, entity: str, *order: str) -> DataFrame:
    """fresh with positions that continue the stored chains (entity, position, id)."""
    last = stored.groupBy(entity).agg(F.max("position").alias("_last"), F.max_by("id", "position").alias("_tail"))
    c = chain(fresh, entity, *order).join(last, entity, "left")
    return c.withColumn("predecessor", F.coalesce("predecessor", "_tail")).withColumn("position", F.col("position") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last", "_tail")


def close_intervals(rows: DataFrame, key: str, start: str) -> DataFrame:
    return rows.withColumn("event_end", F.lead(start).over(Window.partitionBy(key).orderBy(start, "id")))


def budget_prefix(rows: DataFrame, cost: str, budget: int, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows while their running cost stays within the budget; the first overflow ends it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def reversal_chain(spark, versions: DataFrame, start: int, most: int = 20) -> DataFrame:
    """(depth, version_id): superseded_by links from a version, by a recursive query."""
    return spark.sql(
        """WITH RECURSIVE chain(depth, version_id, superseded_by) AS (
             SELECT 0, version_id, superseded_by FROM {v} WHERE version_id = :start
             UNION ALL
             SELECT c.depth + 1, v.version_id, v.superseded_by FROM chain c JOIN {v} v ON v.version_id = c.superseded_by WHERE c.depth < :most)
           SELECT depth, version_id FROM chain""",
        args={"start": start, "most": most},
        v=versions,
    )


def relative_date(text: Column, day: Column) -> Column:
    """The date that the first relative expression of a text means, seen from a day; null if there is none."""
    t = F.lower(text)
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    out = F.when(t.contains("yesterday"), F.date_sub(day, 1)).when(t.contains("tomorrow"), F.date_add(day, 1)).when(t.contains("last week"), F.date_sub(day, 7)).when(t.contains("next week"), F.date_add(day, 7))
    out = out.when(t.contains("last month"), F.add_months(day, -1)).when(t.contains("next month"), F.add_months(day, 1)).when(t.contains("this month"), F.trunc(day, "month"))
    for i, n in enumerate(names):
        back = (F.dayofweek(day) - 1 - i + 6) % 7 + 1
        out = out.when(t.contains("last " + n), F.date_sub(day, back.cast("int")))
    return out


def event_chains(rows: DataFrame, key: str, least: int = 3, score: int = 9) -> DataFrame:
    """Groups with enough members on enough days: score is members times days."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.countDistinct(F.to_date("created_at")).alias("days"))
    return g.withColumn("score", F.col("members") * F.col("days")).where((F.col("members") >= least) & (F.col("days") >= least) & (F.col("score") >= score))
