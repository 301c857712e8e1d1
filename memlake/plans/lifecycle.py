"""Queries over re-ranking by subject and list, answer counts, life cycles, indexing and tiers by rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import text as X
from memlake.operators import lifecycle, packaging, ranking
from memlake.plans.core import M, mem
from memlake.plans.rules import S, has, holds, lit, said
from memlake.registry import query
from memlake.sources.tables import table

KEY = "conv_id, turn"
QUESTION = "When did Anna first visit the doctor?"
WHO, WHAT = ranking.subjects(QUESTION), ranking.keywords(QUESTION)


def _stem(w: str) -> str:
    ends = "".join(f" WHEN length({w}) > {len(e) + 2} AND ends_with({w}, '{e}') THEN left({w}, length({w}) - {len(e)})" for e in ("ing", "ed", "es", "s"))
    return f"CASE {' '.join(f'WHEN {w} = {lit(k)} THEN {lit(v)}' for k, v in R.IRREGULAR.items())}{ends} ELSE {w} END"


_STEMS = rf"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '\b([a-z]+)''s\b', '\1', 'g'), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: {_stem('w')})"
_KEYS = sorted({" ".join(ranking._stem(w) for w in k.split()) for k in WHAT})
_HITS = " + ".join(f"contains(array_to_string(w, ' '), {lit(k)})::INT" if " " in k else f"list_contains(w, {lit(k)})::INT" for k in _KEYS)
_SAID = "list_filter(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+\\b')), lambda x: NOT list_contains([" + ", ".join(lit(x) for x in (*ranking.MONTH_NAMES, *ranking.NO_SUBJECT)) + "], x))"
_WHO = "[" + ", ".join(map(lit, WHO)) + "]"


@query(
    "r10_subject_ranking",
    S(
        f"SELECT {KEY}, round(CASE WHEN hits > 0 THEN base + 2 + (hits - 1) * 0.75 WHEN others > 0 THEN base * 0.25 ELSE base END + 0.4 * ({_HITS}) - CASE WHEN {holds('text', ranking.PLANNING)} THEN 2.25 ELSE 0 END, 6)::DOUBLE AS score FROM"
        f" (SELECT *, 1.0::DOUBLE / (turn + 1) AS base, len(list_intersect(m, {_WHO})) AS hits, len(list_filter(m, lambda x: NOT list_contains({_WHO}, x))) AS others, {_STEMS} AS w FROM (SELECT *, {_SAID} AS m FROM said))"
    ),
)
def subject_ranking(s, d):
    out = ranking.by_subject(said(s, d), QUESTION, F.col("text"), 1.0 / (F.col("turn") + 1))
    return out.select("conv_id", "turn", F.round("score", 6).alias("score"))


LIST_QUESTION = "What songs or bands did she hear, and what pets are named?"


def _words(*w: str) -> str:
    return has("lower(text)", r"\b(" + "|".join(w) + r")\b")


_QUOTE = f"CASE WHEN {has('text', ranking.QUOTED_TITLE)} THEN 3.0 ELSE 0 END"
_SIGNAL = f"(CASE WHEN {has('text', ranking.NAMED)} THEN 3.0 ELSE 0 END + {_QUOTE} + CASE WHEN {_words(*ranking.PETS)} THEN 1.5 ELSE 0 END + CASE WHEN {_words(*ranking.MUSIC)} THEN 1.5 ELSE 0 END)"


@query("r14_list_protection", S(f"SELECT {KEY}, signal::DOUBLE AS signal, coalesce(n <= 2, FALSE) AS protected, round(1.0 / (turn + 1) + CASE WHEN n <= 2 THEN 4 ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT *, CASE WHEN signal >= 3 THEN row_number() OVER (PARTITION BY conv_id, signal >= 3 ORDER BY signal DESC, turn) END AS n FROM (SELECT *, {_SIGNAL} AS signal FROM said))"))
def list_protection(s, d):
    x = said(s, d).withColumn("id", F.col("turn")).withColumn("score", 1.0 / (F.col("turn") + 1))
    out = ranking.protect_lists(x, "conv_id", LIST_QUESTION, F.col("text"), 2)
    return out.select("conv_id", "turn", "signal", "protected", F.round("score", 6).alias("score"))


@query(
    "r7_link_expansion",
    M(
        ", top AS (SELECT user_id, id, importance AS score FROM memories QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) <= 3), links AS (SELECT id AS src, (id * 7 + 3) % 500 AS dst, 0.5 AS score FROM memories UNION ALL SELECT id, (id * 3 + 1) % 500, 0.4 FROM memories),"
        " near AS (SELECT t.user_id, m.id, 0.45 AS score FROM (SELECT DISTINCT user_id FROM top) t JOIN memories m USING (user_id) WHERE m.id % 5 = 0), more AS (SELECT t.user_id, l.dst AS id, l.score, 'link' AS source FROM top t JOIN links l ON t.id = l.src UNION ALL SELECT user_id, id, score, 'neighbour' FROM near),"
        " one AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.user_id = m.user_id AND t.id = m.id) QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY score DESC, source) = 1)"
        " SELECT user_id, id, score::DOUBLE AS score, 'search' AS source FROM top UNION ALL SELECT user_id, id, score::DOUBLE, source FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) <= 5)"
    ),
)
def link_expansion(s, d):
    from memlake.operators.search import top_k

    m = mem(s, d).select("user_id", "id", F.col("importance").cast("double").alias("score"))
    top = top_k(m, 3, F.desc("score"), F.asc("id"), by=("user_id",))
    link = lambda a, b, v: m.select(F.col("id").alias("src"), ((F.col("id") * a + b) % 500).alias("dst"), F.lit(v).alias("score"))
    near = m.join(top.select("user_id").distinct(), "user_id").where("id % 5 = 0").select("user_id", "id", F.lit(0.45).alias("score"))
    return ranking.expand_by_links(top, link(7, 3, 0.5).union(link(3, 1, 0.4)), near, "user_id", 5)


@query("g17_distinct_things")
def distinct_things(s, d):
    return ranking.count_distinct_things(said(s, d).withColumn("rank", F.col("turn")), "conv_id", F.col("text"))


_CSTOP = "[" + ", ".join(map(lit, ranking.COUNT_STOP)) + "]"
_PLAIN = r"lower(regexp_replace(regexp_replace(text, '^[-•*\d.)\s]+', ''), '^\s+|\s+$', '', 'g'))"


@query("g17b_count_keys", S(rf"SELECT {KEY}, CASE WHEN len(w) > 0 THEN array_to_string(w[1:5], ' ') ELSE left(p, 80) END AS key FROM (SELECT *, list_filter(regexp_split_to_array(p, '\s+'), lambda x: length(x) > 3 AND NOT list_contains({_CSTOP}, x)) AS w FROM (SELECT *, {_PLAIN} AS p FROM said))"))
def count_keys(s, d):
    return said(s, d).select("conv_id", "turn", ranking.count_key(F.col("text")).alias("key"))


def _machine(legal: dict) -> str:
    return "CASE " + " ".join(f"WHEN state = {lit(a)} AND event = {lit(b)} THEN {lit(n)}" for (a, b), n in legal.items()) + " END"


def _states(legal: dict) -> tuple[list[str], list[str]]:
    return sorted({a for a, _ in legal} | set(legal.values())), sorted({b for _, b in legal})


def _machine_sql(legal: dict) -> str:
    states, events = _states(legal)
    pick = lambda xs, e: "[" + ", ".join(map(lit, xs)) + f"][({e} % {len(xs)} + 1)::INT]"
    return (
        f"SELECT event_id, coalesce(n, state) AS state, n IS NOT NULL AS applied, attempt + (n IS NOT NULL AND event IN ('claim', 'put'))::INT AS attempt FROM (SELECT *, CASE WHEN event_id % 11 > 0 THEN {_machine(legal)} END AS n FROM"
        f" (SELECT event_id, {pick(states, 'event_id')} AS state, {pick(events, 'user_id')} AS event, (event_id % 3)::INT AS attempt FROM events))"
    )


def _machine_run(s, d, legal: dict):
    states, events = _states(legal)
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    e = table(s, d, "events")
    rows = e.select("event_id", pick(states, "event_id").alias("state"), (F.col("event_id") % 3).cast("int").alias("attempt"))
    asked = e.select("event_id", pick(events, "user_id").alias("event"), ((F.col("event_id") % 3) + (F.col("event_id") % 11 == 0).cast("int")).cast("int").alias("attempt"))
    return lifecycle.apply_events(rows, asked, "event_id", legal).select("event_id", "state", "applied", "attempt")


@query("b18_upload_slots", _machine_sql(lifecycle.UPLOAD))
def upload_slots(s, d):
    return _machine_run(s, d, lifecycle.UPLOAD)


@query("b15_artifact_states", _machine_sql(lifecycle.ARTIFACT))
def artifact_states(s, d):
    return _machine_run(s, d, lifecycle.ARTIFACT)


_UP = ["blob_stored", "blob_pending", "blob_available", "blob_uploading", "raw_storage_failed", "registered"]


@query("f48_upload_decision", f"SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CASE WHEN st IN ('blob_stored', 'blob_pending', 'blob_available') THEN 'return_existing' WHEN st = 'blob_uploading' AND event_id % 2 = 0 THEN 'finalize' WHEN st IN ('blob_uploading', 'raw_storage_failed') THEN 'reclaim_and_upload' END END AS decision FROM (SELECT event_id, [{', '.join(map(lit, _UP))}][(user_id % 6 + 1)::INT] AS st FROM events)")
def upload_decision(s, d):
    state = F.element_at(F.array(*map(F.lit, _UP)), (F.col("user_id") % 6 + 1).cast("int"))
    return table(s, d, "events").select("event_id", lifecycle.upload_decision(state, F.col("event_id") % 5 > 0, F.col("event_id") % 2 == 0).alias("decision"))


@query("f48b_final_state", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'blob_pending' WHEN user_id % 2 = 0 THEN 'blob_available' ELSE 'blob_stored' END AS state FROM events")
def final_state(s, d):
    stored = F.when(F.col("event_id") % 3 == 0, "pending").otherwise("stored")
    return table(s, d, "events").select("event_id", lifecycle.final_state(stored, F.when(F.col("user_id") % 2 == 0, "filecoin").otherwise("local")).alias("state"))


@query("f46_uri_parts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'memory' WHEN 3 THEN 'directory' ELSE 'claim' END AS kind, CASE event_id % 4 WHEN 3 THEN 'work/' || event_type ELSE user_id::VARCHAR END AS id, CASE WHEN event_id % 4 = 2 THEN '2024-01-01T00:00:00Z' END AS as_of FROM events")
def uri_parts(s, d):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    uri = F.when(k == 0, F.concat(F.lit("mem://memory/"), u)).when(k == 1, F.concat(F.lit("mem://claim/"), u)).when(k == 2, F.concat(F.lit("mem://claim/"), u, F.lit("@2024-01-01T00:00:00Z"))).otherwise(F.concat(F.lit("mem://work/"), F.col("event_type")))
    return table(s, d, "events").select("event_id", lifecycle.uri_parts(uri).alias("p")).select("event_id", "p.kind", "p.id", "p.as_of")


@query("f51_slugs", "SELECT page_id, nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '') AS slug FROM pages")
def slugs(s, d):
    return table(s, d, "pages").select("page_id", lifecycle.slug(F.col("url")).alias("slug"))


@query("u23_document_index")
def document_index(s, d):
    """Documents whose text is not yet indexed, or was under another hash."""
    docs = table(s, d, "documents")
    known = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("old").alias("hash"), F.lit(4).alias("generation"))
    return lifecycle.index_documents(docs, known, "doc_id", "text").drop("content")


@query("b14_replace_children", "SELECT conv_id, turn, 'old' AS v FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3) UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE turn = 3")
def replace_children(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    return lifecycle.replace_generation(c.withColumn("v", F.lit("old")), c.where("turn = 3").withColumn("v", F.lit("new")), "conv_id")


@query("b11_document_cascade", M("SELECT id, CASE WHEN id % 7 = 2 THEN coalesce(deleted_at, TIMESTAMP '2024-02-01') ELSE deleted_at END AS deleted_at FROM memories"))
def document_cascade(s, d):
    m = mem(s, d).select("id", F.col("id").alias("document_id"), "deleted_at")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    gone = docs.where("document_id % 7 = 2").select("document_id")
    _, memories = lifecycle.delete_documents(docs, m, gone, F.lit("2024-02-01").cast("timestamp_ntz"))
    return memories.select("id", "deleted_at")


@query("b19_reconcile_batch", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 25")
def reconcile_batch(s, d):
    return lifecycle.claim_batch(table(s, d, "events"), F.col("event_type") == "error", [F.asc("ts"), F.asc("event_id")], 25).select("event_id")


@query("f42_tiers_by_rank")
def tiers_by_rank(s, d):
    return packaging.tiers_by_rank(mem(s, d).withColumn("rank", F.col("id")), "user_id", 2000)


@query("f43_visible_terms")
def visible_terms(s, d):
    return packaging.tiers_by_rank(mem(s, d).withColumn("rank", F.col("id")), "user_id", 4000, ["tion", "here"])


@query("c5_session_gate", M("SELECT m.id FROM memories m JOIN episodes e USING (episode_id) WHERE e.session_id = 's3'", "episodes"))
def session_gate(s, d):
    from memlake.sources.tables import view

    scope = view(s, d, "episodes").where("session_id = 's3'").select("episode_id")
    return mem(s, d).join(scope, "episode_id", "left_semi").select("id")


@query("u16_slot_backfill", "SELECT event_id, 'located_in:' || (user_id % 30) || ':' || event_type AS slot FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 30, event_type ORDER BY ts DESC, event_id DESC) = 1")
def slot_backfill(s, d):
    from memlake.operators.search import top_k

    e = table(s, d, "events").withColumn("slot", F.concat_ws(":", F.lit("located_in"), (F.col("user_id") % 30).cast("string"), "event_type"))
    return top_k(e, 1, F.desc("ts"), F.desc("event_id"), by=("slot",)).select("event_id", "slot")


@query("u14_consolidation", M("SELECT user_id, topic, count(*) AS members, least(1.0, max(importance) + 0.05)::DOUBLE AS importance, string_agg(id::VARCHAR, ',' ORDER BY id) AS archived FROM memories GROUP BY user_id, topic HAVING count(*) >= 2"))
def consolidation(s, d):
    """Clusters of a user's topic become one memory each; the members are archived."""
    g = mem(s, d).groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("importance").cast("double")).alias("top"), F.array_sort(F.collect_list("id")).alias("ids")).where("members >= 2")
    return g.select("user_id", "topic", "members", F.least(F.lit(1.0), F.col("top") + 0.05).alias("importance"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("archived"))


@query("u19_lessons", "SELECT user_id % 10 AS user_id, event_type AS type, count(*) FILTER (WHERE value >= 50) AS active, count(*) FILTER (WHERE value < 50) AS inactive FROM events GROUP BY ALL")
def lessons(s, d):
    """Lessons by user and type; those below the score are inactive."""
    e = table(s, d, "events").groupBy((F.col("user_id") % 10).alias("user_id"), F.col("event_type").alias("type"))
    return e.agg(F.count_if(F.col("value") >= 50).alias("active"), F.count_if(F.col("value") < 50).alias("inactive"))


@query("s15_except_intersect", "SELECT user_id, 'except' AS op FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT user_id, 'intersect' FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def except_intersect(s, d):
    of = lambda t: table(s, d, "events").where(F.col("event_type") == t).select("user_id")
    a, b = of("click"), of("error")
    return a.subtract(b).withColumn("op", F.lit("except")).unionByName(a.intersect(b).withColumn("op", F.lit("intersect")))


@query("f38_json_objects", "SELECT event_id, props AS object FROM events")
def json_objects(s, d):
    """Objects as a model may return them: plain, fenced, within other text, or broken off."""
    p, k = F.col("props"), F.col("event_id") % 4
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("answer: "), p, F.lit(" {done}"))).otherwise(F.substring(p, F.lit(1), F.length(p) - 1))
    return table(s, d, "events").select("event_id", X.json_object(raw).alias("object"))
