"""Derived texts: profiles, recaps and entity cards, built by extraction where no model is given.

A derived text is made of a group's few best lines, so a group never meets in one row: the best are a
rank that Spark limits within tasks, the group's figures are pre-aggregated.  A model takes the place of
``summarise``, which joins lines, as a function on the column of lines.

Defined results: null content is no line; groups with fewer members than asked for have no text; ties go
to the smaller id; a card whose text is the same keeps its version; an empty table has no texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.search import top_k

LINE = 120


def line(content: Column) -> Column:
    """A text as one short line."""
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    return F.when(F.length(flat) <= LINE, flat).otherwise(F.concat(F.substring(flat, 1, LINE - 3), F.lit("...")))


def summarise(lines: Column) -> Column:
    """The default summary: the lines as they are."""
    return F.array_join(lines, "\n")


def digests(rows: DataFrame, group: list[str], k: int, least: int = 1, summary: Callable[[Column], Column] = summarise) -> DataFrame:
    """(group..., members, first_at, last_at, text): the k most important lines of each group of at least ``least`` members.

    rows: (group..., id, content, importance, created_at).
    """
    said = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    figures = said.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")).where(F.col("members") >= least)
    best = top_k(said.select(*group, "id", "content", F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("weight")), k, F.desc("weight"), F.asc("id"), by=tuple(group))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "id", line(F.col("content")).alias("line")))), lambda x: x["line"])
    return figures.join(best.groupBy(*group).agg(summary(lines).alias("text")), group)


def profiles(rows: DataFrame, user: str, section: str, k: int = 3) -> DataFrame:
    """(user, members, text): for each user a section of the k best lines for each kind of memory, in order of kinds."""
    parts = digests(rows.where(F.col(section).isNotNull()), [user, section], k)
    body = F.concat(F.lit("## "), F.col(section).cast("string"), F.lit(" ("), F.col("members").cast("string"), F.lit(")\n"), F.col("text"))
    # As many parts as there are kinds.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(section).alias("s"), body.alias("b")))), lambda x: x["b"])
    return parts.groupBy(user).agg(F.sum("members").alias("members"), F.array_join(ordered, "\n").alias("text"))


def cards(rows: DataFrame, group: list[str], stored: DataFrame, k: int = 5) -> DataFrame:
    """(group..., members, text, version, changed): cards after new rows; a text that differs from the stored one is a new version.

    stored: (group..., text, version) of the cards so far.
    """
    new = digests(rows, group, k).select(*group, "members", "text")
    old = stored.select(*group, F.col("text").alias("_text"), F.col("version").alias("_version"))
    both = new.join(old, group, "left")
    same = F.coalesce(F.col("text") == F.col("_text"), F.lit(False))
    version = F.when(same, F.col("_version")).otherwise(F.coalesce("_version", F.lit(0)) + 1)
    return both.select(*group, "members", "text", version.cast("int").alias("version"), (~same).alias("changed"))


def recaps(rows: DataFrame, group: list[str], least: int, k: int, most: int) -> DataFrame:
    """digests of the largest groups, ``most`` in all, with their place."""
    all_ = digests(rows, group, k, least)
    top = all_.orderBy(F.desc("members"), *group).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("members"), *group)))
