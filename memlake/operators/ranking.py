"""Re-ranking by what a question is about: its subjects, its literal lists, its link neighbours; counting answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.operators.search import top_k

# Fixed values.
MONTH_NAMES = tuple(m.capitalize() for m in R.MONTHS)
NO_SUBJECT = ("As", "User")
QUESTION_WORDS = ("When", "What", "Where", "Why", "How", "Who", "Which", "Did", "Does", "Do", "Has", "Have", "Had")
KEYWORD_STOP = (
    "when", "what", "where", "why", "how", "who", "which", "did", "does", "do", "has", "have", "had", "her", "his", "their", "the", "a", "an", "at", "in", "on", "to", "and", "between", "first",
    "second", "many", "much", "months", "month", "weeks", "week", "years", "year", "days", "day", "lapsed", "elapsed", "passed", "before", "after",
)
EVENT_QUESTION = r"(?i)\b(when|how long|how many months|how many years|how many weeks|how many days|between|first|second|before|after)\b"
PLANNING = ("plan to", "planned to", "planning to", "going to", "will ", "wants to", "want to", "thinking of", "thinking about", "considering", "decided to make", "make a new appointment", "book a new appointment")
SUBJECT, FURTHER, CONFLICT, KEYWORD, PLANNED = 2, 0.75, 0.25, 0.4, 2.25
PETS, MUSIC = ("pet", "pets", "cat", "cats", "dog", "dogs"), ("artist", "artists", "band", "bands", "music", "musical", "concert", "song", "songs")
BOOKS, NAMES = ("book", "books", "title", "read", "reading"), ("name", "names", "called", "named")
SEEN, PERFORMED = ("seen", "saw", "attended", "concert", "show"), ("played", "playing", "dancing", "singing", "live", "stage", "show", "concert")
ATTENDED = ("attended", "saw", "seen", "concert", "show")
QUOTED_TITLE, LEADING_TITLE = "[\"'“‘][A-Z][^\"'”’]{2,}[\"'”’]", "^\\s*[\"'“‘][A-Z][^\"'”’]{2,}[\"'”’]"
NAMED = r"\bnamed\s+[A-Z][A-Za-z'-]+"
STRONG, BONUS = 3, 4


def subjects(query: str) -> list[str]:
    """Single capitalised words of a question: names, but no months, question words or parts of longer names."""
    words = [re.sub("[^A-Za-z]", "", w) for w in query.split()]
    named = [bool(re.fullmatch("[A-Z][a-z]+", w)) and w not in QUESTION_WORDS for w in words]
    alone = [w for i, w in enumerate(words) if named[i] and not (i and named[i - 1]) and not (i + 1 < len(words) and named[i + 1])]
    return list(dict.fromkeys(w for w in alone if w not in MONTH_NAMES + NO_SUBJECT))


def _stem(word: str) -> str:
    if word in R.IRREGULAR:
        return R.IRREGULAR[word]
    return next((word[: -len(s)] for s in ("ing", "ed", "es", "s") if len(word) > len(s) + 2 and word.endswith(s)), word)


def keywords(query: str) -> list[str]:
    """Words of a question beside its subjects, their stems, and the first pairs of each."""
    mine = {x.lower() for x in subjects(query)}
    words = [w for w in re.sub(r"[^a-z0-9\s]", " ", query.lower()).split() if len(w) > 2 and w not in KEYWORD_STOP and w not in mine]
    stems = [x for x in map(_stem, words) if len(x) > 2]
    pairs = lambda x: [" ".join(p) for p in zip(x, x[1:], strict=False)][:4]
    return list(dict.fromkeys([*words, *stems, *pairs(words), *pairs(stems)]))


def by_subject(rows: DataFrame, query: str, text: Column, score: Column) -> DataFrame:
    """rows with ``score`` raised for the question's subjects and keywords, cut for others' and for mere plans."""
    who, what = subjects(query), keywords(query)
    if not who and not what:
        return rows.withColumn("score", score)
    said = F.array_distinct(F.regexp_extract_all(text, F.lit(R.edged(r"(\b[A-Z][a-z]+\b)")), F.lit(1)))
    said = F.filter(said, lambda w: ~w.isin(*MONTH_NAMES, *NO_SUBJECT))
    wanted = F.array(*map(F.lit, who)) if who else F.array().cast("array<string>")
    hits, others = F.size(F.array_intersect(said, wanted)), F.size(F.array_except(said, wanted))
    value = F.when(hits > 0, score + SUBJECT + (hits - 1) * FURTHER).when(others > 0, score * CONFLICT).otherwise(score)
    if what:
        value = value + KEYWORD * R.keyword_matches(text, what)
    if re.search(EVENT_QUESTION, query.lower()):
        value = value - F.when(R.any_in(text, PLANNING), F.lit(PLANNED)).otherwise(0.0)
    return rows.withColumn("score", value)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return R.matches(text, r"\b(" + "|".join(words) + r")\b")


def list_signal(query: str, text: Column) -> Column:
    """How strongly a text answers a question for a list of names, pets, music or books."""
    q = query.lower()
    wants = lambda words: bool(re.search(r"\b(" + "|".join(words) + r")\b", q))
    low, names, pets, music, books, seen = F.lower(text), wants(NAMES), wants(PETS), wants(MUSIC), wants(BOOKS), wants(SEEN)
    add = lambda c, x: F.when(c, F.lit(float(x))).otherwise(F.lit(0.0))
    out, leading = F.lit(0.0), text.rlike(LEADING_TITLE)
    if names or pets:
        out = out + add(R.matches(text, NAMED), 3)
    quoted = add(text.rlike(QUOTED_TITLE), 3) if music or books else F.lit(0.0)
    out = out + (F.when(leading, 4.0).when(_has(low, ATTENDED), 3.0).otherwise(quoted) if music and seen else quoted)
    for wanted, words in ((pets, PETS), (music, MUSIC), (books, BOOKS)):
        if wanted:
            out = out + add(_has(low, words), 1.5)
    return out + add(leading & _has(low, PERFORMED), 2.5) if music and seen else out


def protect_lists(rows: DataFrame, by: str, query: str, text: Column, most: int) -> DataFrame:
    """rows with ``score`` raised for the few rows of each list that answer a question for a list."""
    marked = rows.withColumn("signal", list_signal(query, text))
    best = top_k(marked.where(F.col("signal") >= STRONG), most, F.desc("signal"), F.asc("id"), by=(by,)).select(by, "id", F.lit(True).alias("protected"))
    out = marked.join(best, [by, "id"], "left")
    return out.withColumn("score", F.col("score") + F.when(F.col("protected"), F.lit(float(BONUS))).otherwise(0.0)).withColumn("protected", F.coalesce("protected", F.lit(False)))


def expand_by_links(rows: DataFrame, links: DataFrame, neighbours: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, id, score, source): each list with its best further rows, from links (src, dst, score) and neighbours (by, id, score)."""
    mine = rows.select(by, "id")
    linked = mine.join(links, mine["id"] == links["src"]).select(by, F.col("dst").alias("id"), "score", F.lit("link").alias("source"))
    more = linked.unionByName(neighbours.select(by, "id", "score", F.lit("neighbour").alias("source"))).join(mine, [by, "id"], "left_anti")
    more = top_k(more, 1, F.desc("score"), F.asc("source"), by=(by, "id"))
    return rows.select(by, "id", "score", F.lit("search").alias("source")).unionByName(top_k(more, budget, F.desc("score"), F.asc("id"), by=(by,)))


def by_session(rows: DataFrame, by: str, text: Column) -> DataFrame:
    """rows with tier and place: sessions in the order of their best rows, within them by tier, then by time."""
    session = Window.partitionBy(by, "episode_id")
    rows = rows.withColumn("tier", R.session_tier(text)).withColumn("_best", F.min("tier").over(session))
    rows = rows.withColumn("_first", F.min(F.when(F.col("tier") == F.col("_best"), F.col("created_at"))).over(session))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_first", "episode_id", "tier", "created_at", "id"))
    return rows.withColumn("place", place).drop("_best", "_first")


# Words that say nothing about what is counted.
COUNT_STOP = (
    "user", "wants", "want", "need", "needs", "says", "said", "mentioned", "discuss", "discussed", "note", "noted", "adds", "added", "tries", "tried", "handle", "handles", "handled", "handling",
    "using", "used", "uses", "implement", "implementing", "implemented", "with", "that", "this", "from", "have", "their", "they", "will", "about", "also", "more", "when", "make", "made", "should",
    "would", "could", "into", "some",
)


def count_key(text: Column) -> Column:
    """The first five telling words of a text, or its first 80 characters if it has none."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"^[-•*\d.)\s]+", ""), r"^\s+|\s+$", ""))
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*COUNT_STOP))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 5), " ")).otherwise(F.substring(plain, 1, 80))


def count_distinct_things(rows: DataFrame, by: str, text: Column, rank: str = "rank") -> DataFrame:
    """(by, n): how many different things a list names; a thing is one with an earlier one if half of their words are the same.

    A list is a search result, so bounded; the comparison is with the things kept so far, in order of rank.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[str]] = []
        for key in pdf.sort_values(rank, kind="stable")["key"]:
            words = set(key.split())
            if not any(words == k or (words and k and 2 * len(words & k) >= len(words | k)) for k in kept):
                kept.append(words)
        return pd.DataFrame({by: pdf[by].head(1), "n": [len(kept)]})

    keyed = rows.select(by, rank, count_key(text).alias("key")).dropDuplicates([by, rank])
    return keyed.groupBy(by).applyInPandas(count, f"{by} {dict(rows.dtypes)[by]}, n long")
