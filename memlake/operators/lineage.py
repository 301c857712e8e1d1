"""From a new fact to what is written: conflict candidates, a decision, and its lineage in one pass.

Candidates of a fact are the nearest memories of its user, those that share its telling words, and the
one that holds its slot, merged by the larger similarity.  A decision on them becomes rows of several
tables at once (objects, memories, claims, versions, evidence, and the closing of what they replace)
under keys made of what they are about, so a batch that is run again writes the same rows.

Scale: near memories and shared words come from blocks of facts and memories of one user, of which each
keeps its best; slots from an equi-join; each arm keeps a bounded number for each fact before the merge, so a
fact's candidates fit in one row.  Lineage is an explode of a short array, in the facts' own partitions.

Defined results: a fact without words or vector has no candidates of that arm; a fact without a slot none
of the last; ties go to the smaller id; a fact without candidates is an addition; an action on a target
that isn't among the candidates is one too; NOOP and CLARIFY write nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.operators import conflict, textindex, write
from memlake.operators.similarity import nearest

NEAR, NEAREST, WORDY = 0.7, 3, 5
LONG_WORD = 8


def near(facts: DataFrame, memories: DataFrame, least: float = NEAR, k: int = NEAREST) -> DataFrame:
    """(fact_id, id, similarity): the k nearest memories of each fact's user with a cosine of at least ``least``."""
    asked = facts.select(F.col("fact_id").alias("question_id"), "user_id", F.col("embedding").alias("vector"))
    return nearest(asked, memories, "user_id", k, least).withColumnRenamed("question_id", "fact_id")


def wordy(facts: DataFrame, memories: DataFrame, k: int = WORDY) -> DataFrame:
    """(fact_id, id, similarity): the k memories of each fact's user that have most of its words, by weight."""
    words = R.conflict_keywords(F.col("fact"))
    asked = facts.select(F.col("user_id").alias("grp"), F.col("fact_id").alias("question_id"), words.alias("terms"), F.transform(words, lambda w: F.when(F.length(w) >= LONG_WORD, 1.5).otherwise(1.0)).alias("weights"))
    asked = asked.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda s, w: s + w))
    held = memories.select(F.col("user_id").alias("grp"), "id", R.conflict_keywords(F.col("content")).alias("terms")).withColumn("tf", F.transform("terms", lambda w: F.lit(0).cast("long"))).withColumn("length", F.lit(1))
    got = textindex.overlaps(asked, held, k)
    return got.select(F.col("question_id").alias("fact_id"), "id", F.least(F.lit(0.89), 0.45 + 0.44 * F.col("got") / F.col("total")).alias("similarity"))


def slotted(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(fact_id, id, similarity): the memory that holds a fact's slot, the latest of several."""
    holder = memories.where("slot IS NOT NULL").groupBy("user_id", "slot").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return facts.join(holder, ["user_id", "slot"]).select("fact_id", "id", F.lit(1.0).alias("similarity"))


def candidates(facts: DataFrame, memories: DataFrame, least: float = NEAR, k: int = NEAREST, words: int = WORDY) -> DataFrame:
    """(fact_id, id, similarity, by_slot): what a fact may conflict with.

    facts: (fact_id, user_id, fact, embedding, slot); memories: (id, user_id, content, embedding, slot, created_at).
    """
    arms = [a.withColumn("by_slot", F.lit(s)) for a, s in ((near(facts, memories, least, k), False), (wordy(facts, memories, words), False), (slotted(facts, memories), True))]
    return reduce(DataFrame.unionByName, arms).groupBy("fact_id", "id").agg(F.max("similarity").alias("similarity"), F.bool_or("by_slot").alias("by_slot"))


def decided(facts: DataFrame, memories: DataFrame, found: DataFrame) -> DataFrame:
    """facts with their candidates, the proposed action on the first of them, and the action after the policies.

    The proposal is the default rules'; facts also have: confidence, importance, keywords, updated.
    """
    known = found.join(memories.select("id", "content", F.col("importance").cast("double").alias("importance"), "agent_id"), "id")
    order = F.struct((-F.col("similarity")).alias("o"), "id", "content", "importance", "similarity", "agent_id", "by_slot")
    mine = known.groupBy("fact_id").agg(F.array_sort(F.collect_list(order)).alias("candidates"))
    rows = facts.join(mine, "fact_id", "left")
    none = F.array().cast("array<struct<o:double,id:bigint,content:string,importance:double,similarity:double,agent_id:string,by_slot:boolean>>")
    rows = rows.withColumn("candidates", F.coalesce("candidates", none)).withColumn("_first", F.get("candidates", 0))
    first = F.col("_first")
    shared = F.size(F.array_intersect(R.conflict_keywords(F.col("fact")), R.conflict_keywords(F.coalesce(first["content"], F.lit(""))))) > 0
    against = F.coalesce(R.contradicts(F.col("fact"), first["content"]), F.lit(False))
    action = write.decide(first["similarity"], shared, against, F.coalesce(first["by_slot"], F.lit(False)), F.col("confidence") >= conflict.CLARIFY_BELOW)
    rows = rows.withColumn("action", action).withColumn("target_id", F.when(F.col("action") != "ADD", first["id"])).drop("_first")
    return conflict.apply_policies(rows)


# Lineage -----------------------------------------------------------------------------------------

#: One row for each thing written; ``ref`` is what it belongs to or replaces.
ROW = ("table", "id", "ref", "memory_id", "mutation", "content", "importance", "reason")


def key(kind: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 32)


def memory_key(user: Column, fact: Column) -> Column:
    return key("memory", user, fact)


def first_claim(user: Column, memory: Column) -> tuple[Column, Column]:
    """Claim and version of a memory that was written before there were claims."""
    return key("claim", user, memory), key("version", user, memory, F.lit("backfill"))


def _row(table: str, **values: Column) -> Column:
    return F.struct(F.lit(table).alias("table"), *[values.get(c, F.lit(None)).cast("double" if c == "importance" else "string").alias(c) for c in ROW[1:]])


def lineage(decisions: DataFrame) -> DataFrame:
    """(user_id, fact_id, table, id, ref, memory_id, mutation, content, importance, reason): all that a batch of decisions writes.

    decisions: (fact_id, user_id, fact, importance, action, target_id, candidates, updated).  Tables:
    object (ref: the object it follows), memory, claim (ref: its current version), version (ref: its
    claim), evidence (ref: its version), closed (a version; ref: what replaces it), expired (a memory).
    """
    user, fact, target = F.col("user_id"), F.col("fact_id"), F.col("target_id")
    there = F.exists("candidates", lambda c: c["id"] == target)
    action = F.when(F.col("action").isin("UPDATE", "SUPERSEDE", "DELETE") & ~F.coalesce(there, F.lit(False)), "ADD").otherwise(F.col("action"))
    rows = decisions.withColumn("_do", action)
    new_memory, text, weight = memory_key(user, fact), F.col("fact"), F.col("importance").cast("double")
    old_claim, old_version = first_claim(user, target)
    new_claim, version = key("claim", user, new_memory), key("version", user, fact, F.col("_do"))
    held = target.cast("string")
    start = F.substring(text, 1, 100)

    def made(mutation: str, claim: Column, memory: Column, content: Column, size: Column, reason: Column, previous: Column | None) -> list[Column]:
        out = [
            _row("version", id=version, ref=claim, memory_id=memory, mutation=F.lit(mutation), content=content, importance=size, reason=reason),
            _row("claim", id=claim, ref=version, mutation=F.lit("invalid" if mutation == "delete" else "active")),
            _row("object", id=key("object", user, fact), ref=key("object", user, target) if previous is not None else F.lit(None), memory_id=memory, mutation=F.lit(mutation), content=content, reason=reason),
        ]
        return out + ([] if previous is None else [_row("closed", id=previous, ref=version, memory_id=held, mutation=F.lit(mutation))])

    none = F.lit(None).cast("string")
    insert = _row("memory", id=new_memory, ref=key("object", user, fact), mutation=F.lit("insert"), content=text, importance=weight)
    proof = lambda memory: _row("evidence", id=key("evidence", user, fact), ref=version, memory_id=memory, content=text)
    gone = _row("expired", id=held, ref=version, mutation=F.lower("_do"))
    writes = {
        "ADD": [insert, *made("add", new_claim, new_memory, text, weight, none, None), proof(new_memory)],
        "UPDATE": [*made("update", old_claim, held, F.col("updated"), weight, F.concat(F.lit('Updated from: "'), start, F.lit('"')), old_version), proof(held)],
        "SUPERSEDE": [insert, *made("supersede", old_claim, new_memory, text, weight, F.concat(F.lit('Superseded memory "'), held, F.lit('" with new fact')), old_version), proof(new_memory), gone],
        "DELETE": [*made("delete", old_claim, none, F.concat(F.lit("[DELETED] "), text), F.lit(0.0), F.concat(F.lit('Deleted memory "'), held, F.lit('" — fact: "'), start, F.lit('"')), old_version), gone],
    }
    emitted = R.first_of([(F.col("_do") == a, F.array(*w)) for a, w in writes.items()], F.array().cast("array<struct<table:string,id:string,ref:string,memory_id:string,mutation:string,content:string,importance:double,reason:string>>"))
    return rows.select("user_id", "fact_id", F.explode(emitted).alias("x")).select("user_id", "fact_id", "x.*")


def backfill(memories: DataFrame) -> DataFrame:
    """The claims, versions and evidence of memories that have none, in the same form."""
    claim, version = first_claim(F.col("user_id"), F.col("id"))
    memory = F.col("id").cast("string")
    rows = F.array(
        _row("version", id=version, ref=claim, memory_id=memory, mutation=F.lit("backfill"), content=F.col("content"), importance=F.col("importance").cast("double")),
        _row("claim", id=claim, ref=version, mutation=F.lit("active")),
        _row("evidence", id=key("evidence", F.col("user_id"), F.col("id"), F.lit("backfill")), ref=version, memory_id=memory, content=F.col("content")),
    )
    return memories.select("user_id", F.lit(None).cast("long").alias("fact_id"), F.explode(rows).alias("x")).select("user_id", "fact_id", "x.*")
