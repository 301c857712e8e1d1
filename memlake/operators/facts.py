"""Facts that split: lateral joins with the table functions of ``functions.facts``.

Every operator takes facts with their columns and returns them once for each row of the function, in the
facts' own partitions; nothing is shuffled but what dedup needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import facts as X
from memlake.functions import rules as R

_PARTS = ("fact", "type", "importance", "keywords")


def _lateral(facts: DataFrame, handler: type, schema: str, *args: str, keep: list[str] | None = None) -> DataFrame:
    """facts (or the columns in ``keep``) joined with the rows that ``handler`` makes of each."""
    made = F.udtf(handler, returnType=schema, useArrow=False)
    kept = facts.columns if keep is None else keep
    new = [c.split()[0] for c in schema.split(", ")]
    # The function's columns stand for the facts' own where names are equal.
    rows = facts.alias("_f").lateralJoin(made(*[F.col(f"_f.{a}").outer() for a in args]).alias("_x"))
    return rows.select(*[F.col(f"_f.{c}") for c in kept if c not in new], *[F.col(f"_x.{c}") for c in new])


def normalise(facts: DataFrame) -> DataFrame:
    """Facts split into facts that say one thing each: recommendations, changes of state, reasons, named pets."""
    return _lateral(facts, X.Normalise, X.FACTS, *_PARTS)


def keywords(facts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., position, keyword) of facts that came without keywords."""
    return _lateral(facts, X.Keywords, "position int, keyword string", "fact", keep=keep)


def entities(facts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., entity, entity_type) of what facts are about."""
    return _lateral(facts, X.Entities, "entity string, entity_type string", *_PARTS, keep=keep)


def relations(facts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., source, relation, target) between the entities of a fact."""
    return _lateral(facts, X.Relations, "source string, relation string, target string", *_PARTS, keep=keep)


def _in_words(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def event_anchors(facts: DataFrame) -> DataFrame:
    """Facts that name the events of dated facts: the day is that of the first relative phrase, else an explicit one, else the day of recording."""
    fact = F.col("fact")
    written = F.nullif(F.regexp_extract(fact, X.RECORDED, 1), F.lit(""))
    recorded = F.try_to_date(written, "MMMM d yyyy")
    first = F.get(F.split(F.split(R.relative_anchors(fact, recorded), ";")[0], ":"), 2)
    relative = F.to_date(F.rpad(F.nullif(first, F.lit("")), 10, "-01"))
    explicit = F.try_to_date(F.nullif(F.regexp_extract(fact, X.OCCURRED, 1), F.lit("")), "MMMM d yyyy")
    event = F.coalesce(relative, explicit, recorded)
    dated = facts.withColumn("recorded", F.when(recorded.isNotNull(), written)).withColumn("event_day", _in_words(event))
    return _lateral(dated, X.Anchors, X.FACTS, *_PARTS, "recorded", "event_day").drop("recorded", "event_day")


def quoted(turns: DataFrame, keep: list[str], speaker: str = "role", text: str = "text") -> DataFrame:
    """Facts of titles, performers and letter writers that turns name; the session's day is in a turn's first line, or isn't known."""
    day = F.try_to_date(F.nullif(F.regexp_extract(F.col(text), r"(?im)^\[Session date:\s*(\d{4}-\d{2}-\d{2})\]", 1), F.lit("")))
    t = turns.withColumn("said_by", F.col(speaker)).withColumn("line", F.substring_index(F.col(text), "\n", 1)).withColumn("day", F.date_format(day, "MMMM d yyyy"))
    return _lateral(t, X.Quoted, X.FACTS, "said_by", "line", "day", keep=keep)


def supplemented(facts: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """facts and those of ``more`` that say what no fact of the same keys says, white space and case aside."""
    said = F.regexp_replace(F.lower(F.trim("fact")), r"\s+", " ").alias("_said")
    known = facts.select(*keys, said).distinct()
    new = more.select("*", said).dropDuplicates([*keys, "_said"]).join(known, [*keys, "_said"], "left_anti")
    return facts.unionByName(new.select(*more.columns), allowMissingColumns=True)


def enriched(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with the event anchors they imply; of facts that say the same under the same keys one stays, an anchor before a fact."""
    anchors = event_anchors(facts).select(*facts.columns)
    both = facts.withColumn("_order", F.lit(0)).unionByName(anchors.withColumn("_order", F.lit(1)))
    said = F.regexp_replace(F.lower(F.trim("fact")), r"\s+", " ")
    best = both.withColumn("_said", said).groupBy(*keys, "_said").agg(F.max_by(F.struct(*facts.columns), F.struct("_order", "fact", "type")).alias("_x"))
    return best.select("_x.*")
