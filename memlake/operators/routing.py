"""What a question's type decides: which blocks an answer is given, whose answer stands, which reflections are read.

All are columns or joins over questions with their type (``rules.question_type``); a batch of questions is
a table.  Defined results: an unknown or null type has no blocks and no reflections; an empty or null
answer is a refusal; ties of reflections go to the smaller id; a question without an answer has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.operators import similarity
from memlake.operators.search import top_k

#: Types that read reflections, and the specialists in the order in which they are asked (fixed values).
REFLECTED = ("summary", "contradiction", "preference", "numeric_count", "exact_date", "ordered_list")
SPECIALISTS = ("cr", "tr", "msr", "ie_ku")
REFUSALS = (
    r"(?i)\b(can(?:not|'t)\s+find|cannot\s+find\s+(?:sufficient|the))", r"(?i)\b(?:do(?:es)?\s+not|don'?t)\s+(?:contain|have)\b", r"(?i)\bno\s+(?:information|relevant\s+memories|matching\s+facts)\b",
    r"(?i)\bnot\s+(?:enough|sufficient)\s+(?:information|context|memories)", r"(?i)\bcontext\s+does\s+not\s+(?:contain|include|specify)\b", r"(?i)\bI\s+(?:am\s+unable|don'?t\s+have\s+enough)",
    r"(?i)\binsufficient\s+(?:information|context|memories)",
)


def channels(kind: Column) -> dict[str, Column]:
    """Whether a question of a type is given its event chains, observations and a format hint."""
    known = F.coalesce(kind, F.lit("other"))
    return {"event_chain": known == "ordered_list", "observations": known.isin("contradiction", "summary"), "format_hint": ~known.isin("preference", "other")}


def refused(answer: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) == "") | F.coalesce(R.any_of(answer, REFUSALS), F.lit(True))


def dispatched(answers: DataFrame, question: str = "question_id") -> DataFrame:
    """(question, specialist, answer): of the specialists' answers that aren't refusals the first in order."""
    order = F.array_position(F.array(*map(F.lit, SPECIALISTS)), F.col("specialist"))
    given = answers.where(F.col("specialist").isin(*SPECIALISTS) & ~refused(F.col("answer")))
    return given.groupBy(question).agg(F.min_by(F.struct("specialist", "answer"), F.struct(order, "answer")).alias("x")).select(question, "x.*")


def reflections(questions: DataFrame, stored: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, id, similarity): the k nearest reflections of the asker, for types that read them.

    questions: (question_id, user_id, kind, vector); stored: (id, user_id, embedding).
    """
    asked = questions.where(F.col("kind").isin(*REFLECTED))
    return similarity.nearest(asked, stored, "user_id", k)


def rescued(answers: DataFrame, first: DataFrame, again: DataFrame, k: int) -> DataFrame:
    """(question_id, id, score, rescued): results of a second search for questions whose answer refuses, merged with the first's.

    answers: (question_id, answer); first, again: (question_id, id, score).  Of a result that both have the
    better score counts; questions that were answered keep their first results.
    """
    failed = answers.where(refused(F.col("answer"))).select("question_id", F.lit(True).alias("rescued"))
    more = again.join(failed.select("question_id"), "question_id", "left_semi")
    both = first.select("question_id", "id", "score").unionByName(more.select("question_id", "id", "score")).groupBy("question_id", "id").agg(F.max("score").alias("score"))
    best = top_k(both, k, F.desc("score"), F.asc("id"), by=("question_id",))
    return best.join(failed, "question_id", "left").select("question_id", "id", "score", F.coalesce("rescued", F.lit(False)).alias("rescued"))
