"""Write path on immutable tables: changes are applied by key, giving a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import similarity
from memlake.sources.tables import cut


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def insert_ignore(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    fresh = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def overlay(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes replace those of the rows with their key; other rows stay."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), F.struct(*cols).alias("_c"))
    j = table.join(c, table[key] == c["_k"], "left")
    new = lambda n: F.when(F.col("_k").isNotNull(), F.col(f"_c.{n}")).otherwise(table[n]).alias(n)
    return j.select(*[new(n) if n in cols else table[n] for n in table.columns])


def upsert(table: DataFrame, rows: DataFrame, key: list[str], newest: str) -> DataFrame:
    """Of stored and incoming rows of a key, the one with the larger ``newest``; ties go to the incoming."""
    both = table.withColumn("_in", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("_in", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(newest), F.desc("_in"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_in")


def merge_metadata(old: Column, patch: Column) -> Column:
    """Shallow merge of maps; the patch wins."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(keep, patch)


def soft_delete(table: DataFrame, ids: DataFrame, at: Column, column: str = "deleted_at") -> DataFrame:
    hit = ids.select(F.col("id").alias("_k")).distinct()
    j = table.join(hit, table["id"] == hit["_k"], "left")
    return j.select(*[F.when(F.col("_k").isNotNull(), F.coalesce(table[c], at)).otherwise(table[c]).alias(c) if c == column else table[c] for c in table.columns])


def touch(table: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """One access more, and when."""
    hit = ids.select(F.col("id").alias("_k")).distinct()
    j = table.join(hit, table["id"] == hit["_k"], "left")
    of = {"access_count": table["access_count"] + 1, "last_accessed_at": at}
    return j.select(*[F.when(F.col("_k").isNotNull(), of[c]).otherwise(table[c]).alias(c) if c in of else table[c] for c in table.columns])


def upsert_links(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(lo, hi, similarity): the largest similarity within the batch, which replaces a stored one."""
    b = batch.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "similarity").where("lo <> hi").groupBy("lo", "hi").agg(F.max("similarity").alias("similarity"))
    return stored.join(b, ["lo", "hi"], "left_anti").unionByName(b)


def upsert_relations(stored: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Largest confidence, latest memory."""
    both = stored.withColumn("_o", F.lit(0)).unionByName(batch.withColumn("_o", F.lit(1)))
    return both.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max_by("memory_id", F.struct("_o", "memory_id")).alias("memory_id"))


def add_alias(aliases: Column, normalised: Column, name: Column) -> Column:
    low = F.lower(F.trim(name))
    known = F.array_contains(aliases, name) | F.array_contains(F.transform(aliases, F.lower), low) | F.array_contains(normalised, low)
    return F.when(F.coalesce(known, F.lit(False)), aliases).otherwise(F.array_append(aliases, name))


def cascade_delete(tables: dict[str, DataFrame], site: str) -> dict[str, DataFrame]:
    """Delete a source's memories and all that hangs on them; claims without a version go too.

    tables: memories (id, source_site, episode_id), versions (version_id, claim_id, memory_id), claims (claim_id),
    links (lo, hi), bridges (memory_id, entity_id), episodes (episode_id).
    """
    gone = tables["memories"].where(F.col("source_site") == site)
    ids = gone.select(F.col("id").alias("memory_id"))
    versions = tables["versions"].join(ids, "memory_id", "left_anti")
    kept = tables["memories"].where(F.coalesce(F.col("source_site") != site, F.lit(True)))
    return {
        "memories": kept,
        "versions": versions,
        "claims": tables["claims"].join(versions, "claim_id", "left_semi"),
        "links": tables["links"].join(ids.withColumnRenamed("memory_id", "lo"), "lo", "left_anti").join(ids.withColumnRenamed("memory_id", "hi"), "hi", "left_anti"),
        "bridges": tables["bridges"].join(ids, "memory_id", "left_anti"),
        "episodes": tables["episodes"].join(gone.select("episode_id"), "episode_id", "left_anti").unionByName(tables["episodes"].join(gone.select("episode_id"), "episode_id", "left_semi").join(kept.select("episode_id"), "episode_id", "left_semi")),
    }


def rekey(table: DataFrame, column: str, old, new, *keys: str) -> DataFrame:
    """Move rows from one owner to another; of rows that then share the keys, one."""
    moved = table.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
    return moved.dropDuplicates(list(keys)) if keys else moved


def transition(state: Column, event: Column, legal: dict[tuple[str, str], str]) -> Column:
    """The next state, or null for an illegal transition (to be quarantined)."""
    out = F.lit(None).cast("string")
    for (a, e), b in legal.items():
        out = F.when((state == a) & (event == e), b).otherwise(out)
    return out


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined), the latter with the names of the rules it breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def slot_key(relation: Column, source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws(":", relation, source, kind, target)


def scd2(changes: DataFrame, key: str, at: str) -> DataFrame:
    """Version history: each change closes the one before; the last is current."""
    w = Window.partitionBy(key).orderBy(at, "version_id")
    return changes.withColumn("valid_to", F.lead(at).over(w)).withColumn("superseded_by", F.lead("version_id").over(w)).withColumn("previous_version", F.lag("version_id").over(w)).withColumn("current", F.col("superseded_by").isNull())


def fast_duplicate(facts: DataFrame, candidates: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Facts whose best candidate is similar enough and has every quoted literal of the fact: (fact_id, candidate_id).

    candidates: (fact_id, candidate_id, similarity, content).
    """
    best = candidates.groupBy("fact_id").agg(F.max_by(F.struct("candidate_id", "similarity", "content"), F.struct("similarity", (-F.col("candidate_id")).alias("c"))).alias("x")).select("fact_id", "x.candidate_id", "x.similarity", F.col("x.content").alias("_c"))
    quoted = F.regexp_extract_all(F.col("content"), F.lit('"([^"]+)"'), F.lit(1))
    j = facts.join(best.where(F.col("similarity") >= threshold), "fact_id")
    return j.where(F.forall(quoted, lambda q: F.col("_c").contains(q))).select("fact_id", "candidate_id")


def decide(similarity: Column, shared: Column, negated: Column, same_slot: Column, trusted: Column) -> Column:
    """Default decision rules, first match wins."""
    return (
        F.when(similarity.isNull() | (similarity < 0.7), "ADD")
        .when(~shared, "ADD")
        .when(same_slot & ~trusted, "CLARIFY")
        .when(negated, "DELETE")
        .when(same_slot, "SUPERSEDE")
        .when(similarity >= 0.95, "NOOP")
        .otherwise("UPDATE")
    )


def override(decision: Column, rules: list[tuple[Column, str]]) -> Column:
    """Policy overrides: the first rule that holds replaces the decision."""
    return F.coalesce(*[F.when(ok, action) for ok, action in rules], decision)


def fold_beliefs(deltas: DataFrame, key: str, start: float = 0.5) -> DataFrame:
    """Confidence after ordered deltas, within 0 and 1 after each."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "delta")))
    step = lambda a, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + x["delta"]))
    return deltas.groupBy(key).agg(F.aggregate(ordered, F.lit(float(start)), step).alias("confidence"))


def auto_resolve(conflicts: DataFrame, now: Column) -> DataFrame:
    due = (F.col("state") == "open") & (F.col("resolve_after") <= now)
    return conflicts.withColumn("state", F.when(due, "auto_resolved").otherwise(F.col("state")))


def resolve_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id) by normalised name or alias; null where a new entity is needed.

    entities: (entity_id, normalised, aliases).
    """
    known = entities.select("entity_id", F.explode(F.array_union(F.array("normalised"), "aliases")).alias("normalised")).groupBy("normalised").agg(F.min("entity_id").alias("entity_id"))
    return names.join(known, "normalised", "left")


def resolve_mentions(mentions: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(id, entity_id, by): the entity of each mention, as if mentions came one by one.

    mentions: (id, ord, user_id, entity_type, name, aliases, embedding).  A name that an entity of the
    user and type has, or has as an alias, is that entity, of several the first; else the most similar
    entity, if its cosine is at least the threshold, which then has the name as an alias; else a new one.
    Entities are named by their first mention's id; ``by`` says which stage found them.

    All mentions of a name follow its first, so names decide, not mentions; and whether a name founds an
    entity depends on earlier founders only, which ``greedy`` settles in rounds.  Null names, and names
    of white space, are one name, which no alias matches.
    """
    scope = ["user_id", "entity_type"]
    m = mentions.withColumn("key", F.coalesce(text.entity_name(F.col("name")), F.lit("")))
    firsts = m.groupBy(*scope, "key").agg(F.min_by(F.struct("id", "ord", "aliases", "embedding"), "ord").alias("x"))
    # Nulls are values of the scope: a pair's scope is one string for joins.
    names = cut(firsts.select(F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}).alias("scope"), *scope, "key", "x.*"))
    near = similarity.similar_pairs(names.select("id", "scope", "embedding"), threshold, "scope").select("a", "b", "similarity")
    alias = names.select("scope", F.col("id").alias("a"), F.col("ord").alias("oa"), F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("alias"))
    alias = alias.select("scope", "a", "oa", text.entity_name(F.col("alias")).alias("key")).where("key <> ''")
    known = alias.join(names.select("scope", "key", F.col("id").alias("b"), F.col("ord").alias("ob")), ["scope", "key"]).where("oa < ob")
    edges = near.withColumn("alias", F.lit(False)).union(known.select("a", "b", F.lit(1.0), F.lit(True)))
    edges = cut(edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.bool_or("alias").alias("alias")))
    order = names.select("id", "ord")
    founders = cut(similarity.greedy(order, edges).select(F.col("centre").alias("f")).distinct())
    ways = edges.union(edges.where("NOT alias").select("b", "a", "similarity", "alias"))
    options = ways.join(founders, ways["a"] == founders["f"], "left_semi").join(founders.withColumnRenamed("f", "b"), "b", "left_anti")
    options = options.join(order.select(F.col("id").alias("a"), F.col("ord").alias("oa")), "a").join(order.select(F.col("id").alias("b"), F.col("ord").alias("ob")), "b").where("oa < ob")
    # An alias before any likeness, the first entity before later ones; then the most similar, of equals the first.
    rank = F.struct(~F.col("alias"), F.when(~F.col("alias"), -F.col("similarity")), "oa")
    follows = options.groupBy("b").agg(F.min_by(F.struct(F.col("a").alias("entity_id"), F.when(F.col("alias"), "alias").otherwise("similar").alias("by")), rank).alias("e"))
    found = names.join(follows, names["id"] == follows["b"], "left").select(*scope, "key", F.col("id").alias("first"), F.coalesce("e.entity_id", "id").alias("entity_id"), F.coalesce("e.by", F.lit("new")).alias("how"))
    same = m["key"] == found["key"]
    for c in scope:
        same = same & m[c].eqNullSafe(found[c])
    return m.join(found, same).select(m["id"], "entity_id", F.when(m["id"] == F.col("first"), F.col("how")).otherwise("name").alias("by"))
