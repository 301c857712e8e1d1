"""Decisions on new facts: write gate, policies, trust, execution; facts found by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules as R

#: Confidence below which a contradiction isn't acted on, and how much more a deletion needs.
CLARIFY_BELOW, DELETE_MORE = 0.8, 0.1
#: Similarity at which a fact may be merged into a memory.
REUSE = 0.95
#: Most that an update may lengthen a memory.
GROWTH = 1.5
#: Importance from which a memory is critical.
CRITICAL = 0.9


def write_gate(rows: DataFrame, text: Column, trust: Column, floor: float = 0.3) -> DataFrame:
    """rows with allowed and blocked_by: the sanitiser comes first, then the trust floor."""
    blocked = R.first_of([(R.any_of(text, list(R.INJECTIONS.values())), "sanitization"), (trust < floor, "trust")], F.lit(None).cast("string"))
    return rows.withColumn("blocked_by", blocked).withColumn("allowed", F.col("blocked_by").isNull())


def only_if_enough(rows: DataFrame, key: str, wanted: Column, least: int) -> DataFrame:
    """The wanted rows of each key that has enough of them, and all rows of the other keys."""
    marked = rows.withColumn("_wanted", wanted)
    count = marked.groupBy(key).agg(F.count_if("_wanted").alias("_n"))
    return marked.join(count, key).where(F.col("_wanted") | (F.col("_n") < least)).drop("_wanted", "_n")


def _any(test) -> Column:
    return F.exists("candidates", test)


def resolved_target() -> Column:
    """The named candidate, or if none is named the first; null if there is none such."""
    named = F.filter("candidates", lambda c: c["id"] == F.col("target_id"))
    return F.when(F.col("target_id").isNotNull(), F.get(named, 0)).otherwise(F.get("candidates", 0))


def apply_policies(rows: DataFrame) -> DataFrame:
    """rows with their action after the conflict policies, the first that applies deciding; ``given`` keeps the old one.

    rows: fact, keywords, action, target_id, confidence, updated, candidates (id, content, importance, similarity).
    """
    rows = rows.withColumn("given", F.col("action")).withColumn("_target", resolved_target()).withColumn("_mine", R.conflict_keywords(F.col("fact")))
    fact, action, target = F.col("fact"), F.col("action"), F.col("_target")
    rows = rows.withColumn("_explicit", R.explicit_replacement(fact)).withColumn("_against", F.coalesce(R.contradicts(fact, target["content"]), F.lit(False)))
    explicit, against = F.col("_explicit"), F.col("_against") & target.isNotNull()
    among = _any(lambda c: c["id"] == F.col("target_id"))
    shared = lambda c: F.size(F.array_intersect("_mine", R.conflict_keywords(c["content"])))
    critical = _any(lambda c: (c["importance"] >= CRITICAL) & (shared(c) > 0) & ((action != "UPDATE") | R.safety_conflict(fact, c["content"])))
    unsure = (action == "CLARIFY") | ((action == "SUPERSEDE") & (F.col("confidence") < CLARIFY_BELOW)) | ((action == "DELETE") & (F.col("confidence") < min(CLARIFY_BELOW + DELETE_MORE, 1.0)))
    mine = F.size(F.filter("keywords", lambda k: F.contains(F.lower(target["content"]), k)))
    reusable = (target["similarity"] >= REUSE) & ((mine >= 2) | ((mine == 1) & (shared(target) >= 2)))
    grown = (action == "UPDATE") & (F.length("updated") > GROWTH * F.length(target["content"]))
    known = lambda c: F.coalesce(c, F.lit(False))
    decided = R.first_of(
        [
            ((action == "CLARIFY") & explicit, F.when(known(among), F.lit("SUPERSEDE")).otherwise(F.lit("CLARIFY"))),
            (known(unsure) & ~explicit, action),
            ((F.size("candidates") > 0) & R.uncertain(fact), "CLARIFY"),
            (action.isin("UPDATE", "SUPERSEDE", "DELETE", "CLARIFY") & known(critical), F.when(against, F.when(action.isin("SUPERSEDE", "UPDATE") & explicit, F.lit("SUPERSEDE")).otherwise(F.lit("CLARIFY"))).otherwise(F.lit("ADD"))),
            (action.isin("SUPERSEDE", "DELETE") & R.matches(fact, R.RECOMMENDED) & target.isNotNull() & ~against, "ADD"),
            (action.isin("UPDATE", "NOOP", "SUPERSEDE") & R.transition(fact), "ADD"),
            ((action == "UPDATE") & F.col("target_id").isNotNull() & known(F.col("updated") != "") & against, "SUPERSEDE"),
            (action.isin("UPDATE", "NOOP") & (target.isNull() | known(grown) | ~known(reusable)), "ADD"),
        ],
        action,
    )
    return rows.withColumn("action", decided).drop("_target", "_mine", "_explicit", "_against")


def trust_override(rows: DataFrame, trust: DataFrame, default: float = 0.5) -> DataFrame:
    """rows in which a caller of less trust than a memory's agent asks for clarification in place of changing it.

    rows: action, target_id, candidates (id, agent_id), caller, caller_trust; trust: agent_id, trust.
    """
    target = F.get(F.filter("candidates", lambda c: c["id"] == F.col("target_id")), 0)
    held = rows.withColumn("_agent", target["agent_id"])
    levels = trust.select(F.col("agent_id").alias("_agent"), F.col("trust").alias("_trust"))
    held = held.join(levels, "_agent", "left")
    weaker = F.col("action").isin("UPDATE", "SUPERSEDE", "DELETE") & (F.col("_agent") != F.col("caller")) & (F.col("caller_trust") < F.coalesce("_trust", F.lit(default)))
    return held.withColumn("action", F.when(F.coalesce(weaker, F.lit(False)), "CLARIFY").otherwise(F.col("action"))).drop("_agent", "_trust")


def entity_scoped(rows: DataFrame, mine: Column, theirs: Column) -> DataFrame:
    """An action on a memory that shares no entity with the fact becomes an addition."""
    return rows.withColumn("action", F.when((F.col("action") == "ADD") | F.coalesce(F.arrays_overlap(mine, theirs), F.lit(False)), F.col("action")).otherwise("ADD"))


def execute(rows: DataFrame, preserve: bool) -> DataFrame:
    """rows with outcome, effects (what is written, in order) and, for opinions, opinion_confidence.

    rows: action, target_id, candidates (id), network, target_confidence.  With ``preserve`` a
    contradiction keeps both memories and is recorded between them.
    """
    action = F.col("action")
    opinion = (F.col("network") == "opinion") & F.col("target_id").isNotNull() & F.col("target_confidence").isNotNull() & (action != "ADD")
    missing = ~F.coalesce(_any(lambda c: c["id"] == F.col("target_id")), F.lit(False))
    arr = lambda *x: F.array(*map(F.lit, x))
    gone = (arr("insert", "contradiction"), "preserved_contradiction") if preserve else None
    cases = [
        (opinion & (action == "SUPERSEDE"), arr("opinion", "insert"), "stored"),
        (opinion, arr("opinion"), F.when(action == "NOOP", "skipped").otherwise("updated")),
        (action == "ADD", arr("insert"), "stored"),
        (action == "NOOP", arr("evidence"), "skipped"),
        (action == "CLARIFY", arr("insert_clarification"), "skipped"),
        (missing, arr("insert"), "stored"),
        (action == "UPDATE", arr("update", "version"), "updated"),
    ]
    cases += [(F.lit(True), *gone)] if gone else [(action == "SUPERSEDE", arr("expire", "insert", "version"), "deleted"), (F.lit(True), arr("delete", "version"), "deleted")]
    rows = rows.withColumn("effects", R.first_of([(c, e) for c, e, _ in cases], F.lit(None).cast("array<string>")))
    rows = rows.withColumn("outcome", R.first_of([(c, o) for c, _, o in cases], F.lit(None).cast("string")))
    return rows.withColumn("opinion_confidence", F.when(opinion, R.opinion_confidence(F.col("target_confidence"), action)))


def rule_facts(turns: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fact, type, importance, keywords): the sentences of each turn that state a fact, each once."""
    x = F.col("fact")
    rows = turns.select(*keys, F.explode(F.array_distinct(R.fact_sentences(F.col(text_col)))).alias("fact"))
    rows = rows.where(R.is_first_person_fact(x) | R.is_standalone_fact(x))
    return rows.select(*keys, "fact", R.fact_type(x).alias("type"), R.fact_importance(x).alias("importance"), R.fact_keywords(x).alias("keywords"))
