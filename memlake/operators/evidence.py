"""Temporal evidence: which dated memories bear on a question about time, for every group at once.

A question that compares a first with a second event gets the two earliest days on which a memory
speaks of all its event's concepts.  Any other question about time gets the three memories that
match it best; if it asks for a duration, the earliest and the latest of them by day, those that only
plan an event left out where two others remain, with the time between.

A question is a scalar, taken apart on the driver; memories are scored by column expressions.  The three
best of a group are a rank that Spark limits within tasks before the shuffle, and the first memory of
each (group, day) is a pre-aggregated minimum, so no group's rows are gathered and none are paired.

Defined results: null content has no match; ties go to the earlier memory, then the smaller id; a group
without a match has no rows; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import rules as R

# Fixed values ------------------------------------------------------------------------------------

REPEATED = r"\bfirst\b.*\bsecond\b"
TEMPORAL = r"\b(when|how long|how many months|how many years|how many weeks|how many days|between|before|after|as of|recently)\b"
DURATION = r"\b(how long|how many months|how many years|how many weeks|how many days|between|before|after)\b"
PLANNING = (
    "plan to", "planned to", "planning to", "going to", "will ", "wants to", "want to", "thinking of", "thinking about", "considering", "decided to make", "make a new appointment",
    "book a new appointment",
)
NO_SUBJECT = (
    "When", "What", "Where", "Why", "How", "Who", "Which", "Did", "Does", "Do", "Has", "Have", "Had", "The", "A", "An", "As", "Of", "And", "Or", "First", "Second",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
NO_TERM = (
    "between", "first", "second", "months", "month", "weeks", "week", "days", "many", "much", "long", "lapsed", "elapsed", "passed", "what", "when", "where", "which", "with", "from", "that", "this",
    "before", "after", "recently", "start", "started", "plan", "planned", "recent", "current", "present", "did", "does", "have", "been",
)
CONCEPTS = (("appointment", "appointments", "check-up", "checkup", "check up", "visit"), ("doctor", "doctor's", "doctors", "doc", "medical", "health"))
IRREGULAR = R.IRREGULAR | {"presence": "present"}
LEAST_TERM, BEST, SHOWN = 4, 3, 160
SUBJECT_BONUS, CONCEPT_BONUS, PLANNING_LOSS = 2, 2, 3


# A question's parts ------------------------------------------------------------------------------


def terms(question: str) -> list[str]:
    words = re.sub(r"[^a-z0-9'\s-]", " ", re.sub(r"\b([a-z]+)'s\b", r"\1", question.lower())).split()
    return [w for w in words if len(w) >= LEAST_TERM and w not in NO_TERM]


def subjects(question: str) -> list[str]:
    names = [m.removesuffix("'s") for m in re.findall(r"\b[A-Z][a-z]+(?:'s)?\b", question)]
    return list(dict.fromkeys(n.lower() for n in names if n not in NO_SUBJECT))


def concepts(question: str) -> list[tuple[str, ...]]:
    """What a question's event is made of, each with the words for it; of a repeated event, what follows its ordinals."""
    clauses = " ".join(re.split(r"\b(?:first|second)\b", question.lower())[1:]) or question
    out = [next((c for c in CONCEPTS if t in c), (t,)) for t in terms(clauses)]
    known = [c for c in dict.fromkeys(out) if c in CONCEPTS]
    # Known concepts count once, unknown terms each time.
    return [c for n, c in enumerate(out) if c not in known or out.index(c) == n]


def _stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    return next((word[: -len(s)] for s in ("ing", "ed", "es", "s") if len(word) > len(s) + 2 and word.endswith(s)), word)


# Columns -----------------------------------------------------------------------------------------


def _total(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def scored(memories: DataFrame, question: str) -> DataFrame:
    """memories with hits (concepts of the question's event), names (its subjects), plans and score."""
    low = F.lower(F.coalesce("content", F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(low, R.edged(r"\b([a-z]+)'s\b"), "$1"), r"[^a-z0-9'\s-]", " ")
    words = F.transform(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= LEAST_TERM), lambda w: R.stem_by(w, IRREGULAR))
    asked = [_stem(t) for t in terms(question)]
    out = memories.withColumn("_words", words).withColumn("_low", low)
    out = out.withColumn("hits", _total([_any(F.col("_low"), g) for g in concepts(question)])).withColumn("names", _total([F.col("_low").contains(s) for s in subjects(question)]))
    out = out.withColumn("plans", _any(F.col("_low"), PLANNING))
    score = _total([F.array_contains("_words", t) for t in asked]) + SUBJECT_BONUS * F.col("names") + CONCEPT_BONUS * F.col("hits") - F.when(F.col("plans"), PLANNING_LOSS).otherwise(0)
    return out.withColumn("score", score.cast("int")).drop("_words", "_low")


def shown(content: Column) -> Column:
    text = F.trim(F.regexp_replace(content, r"\s+", " "))
    return F.when(F.length(text) <= SHOWN, text).otherwise(F.concat(F.substring(text, 1, SHOWN - 3), F.lit("...")))


def in_words(days: Column) -> Column:
    """A number of days as days, weeks or months."""
    counted = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))
    about = lambda per, unit: F.concat(F.lit("~"), counted(F.floor(days / per + 0.5), unit), F.lit(" ("), days.cast("string"), F.lit(" days)"))
    return F.when(days < 7, counted(days, "day")).when(days < 30, about(7, "week")).otherwise(about(30, "month"))


_LINE = ("id", "created_at", "content")


def _lines(rows: DataFrame, group: str, labels: Column, place: Column, elapsed: Column | None = None) -> DataFrame:
    span = F.lit(None).cast("long") if elapsed is None else elapsed
    return rows.select(group, place.cast("int").alias("place"), labels.alias("label"), "id", F.to_date("created_at").alias("day"), shown(F.col("content")).alias("text"), span.alias("days"), in_words(span).alias("elapsed"))


def _between(first: Column, last: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    return F.floor((micros(last) - micros(first)) / 86_400_000_000 + 0.5).cast("long")


def _pairs(ends: DataFrame, group: str, labels: tuple[str, str]) -> DataFrame:
    """One line for each end of (group, a, b) structs, the second with the time between."""
    both = F.array(F.struct(F.lit(1).alias("place"), F.lit(labels[0]).alias("label"), F.col("a").alias("x"), F.lit(None).cast("long").alias("days")),
                   F.struct(F.lit(2).alias("place"), F.lit(labels[1]).alias("label"), F.col("b").alias("x"), _between(F.col("a.created_at"), F.col("b.created_at")).alias("days")))
    each = ends.select(group, F.explode(both).alias("e")).select(group, "e.place", "e.label", "e.x.*", "e.days")
    return _lines(each, group, F.col("label"), F.col("place"), F.col("days"))


def repeated_events(memories: DataFrame, group: str, question: str) -> DataFrame:
    """The two earliest days of each group with a memory of all the event's concepts; none where there is but one."""
    n = len(concepts(question))
    hit = scored(memories, question).where(F.col("hits") >= n) if n else memories.where("false")
    first = hit.groupBy(group, F.to_date("created_at").alias("_day")).agg(F.min(F.struct("created_at", "id", "content")).alias("m"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_day"))
    two = first.withColumn("_r", rank).where("_r <= 2").groupBy(group).agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count(F.lit(1)).alias("_n"))
    return _pairs(two.where("_n = 2"), group, ("first matching event", "second matching event"))


def candidates(memories: DataFrame, group: str, question: str) -> DataFrame:
    """The best matches of each group with their rank: by score, concepts, subjects, done before planned, time."""
    order = [F.desc("score"), F.desc("hits"), F.desc("names"), F.asc("plans"), F.asc("created_at"), F.asc("id")]
    x = scored(memories, question).where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return x.where(F.col("rank") <= BEST)


def matching_events(memories: DataFrame, group: str, question: str) -> DataFrame:
    """The best matches of each group, or for a duration their earliest and latest day with the time between."""
    best = candidates(memories, group, question) if terms(question) else candidates(memories.where("false"), group, question)
    lines = _lines(best, group, F.lit("matching event"), F.col("rank"))
    if not re.search(DURATION, question.lower()):
        return lines
    # From here on a group is three rows at most.
    done = F.sum((~F.col("plans")).cast("int")).over(Window.partitionBy(group)) >= 2
    stable = best.withColumn("_done", done).where("NOT _done OR NOT plans")
    days = stable.groupBy(group, F.to_date("created_at").alias("_day")).agg(F.min(F.struct("rank", *_LINE)).alias("m"))
    ends = days.groupBy(group).agg(F.min(F.struct("_day", "m")).alias("a"), F.max(F.struct("_day", "m")).alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ends = ends.select(group, F.col("a.m").alias("a"), F.col("b.m").alias("b"))
    pairs = _pairs(ends, group, ("earliest matching event", "latest matching event"))
    return pairs.unionByName(lines.join(ends, group, "left_anti"))


def temporal_evidence(memories: DataFrame, group: str, question: str) -> DataFrame:
    """(group, place, label, id, day, text, days, elapsed): evidence lines for a question, by group.

    memories: (group, id, created_at, content).  A question that isn't about time has none.
    """
    low = question.lower()
    none = matching_events(memories.where("false"), group, question)
    general = matching_events(memories, group, question) if re.search(TEMPORAL, low) else none
    if not re.search(REPEATED, low, re.DOTALL):
        return general
    twice = repeated_events(memories, group, question)
    return twice.unionByName(general.join(twice.select(group).distinct(), group, "left_anti"))
