"""Queries over dedup, clustering, text, packaging, the write path and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import scoring
from memlake.functions import text as X
from memlake.functions import vectors as V
from memlake.operators import cluster, dedupe, packaging, temporal, write
from memlake.plans.core import M, T, mem
from memlake.registry import query
from memlake.sources.tables import NOW, shared_dir, table, view, with_views
from memlake.streaming import queues

FP = "substr(regexp_replace(lower(content), '[^a-z0-9]', '', 'g'), 1, 80)"


@query("s5_fingerprint_dedup", M(f", f AS (SELECT user_id, id, importance, {FP} AS fp FROM memories), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, fp ORDER BY importance DESC, id) = 1 OR fp = '' AS first FROM f), h AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id) AS n FROM g) SELECT user_id, id FROM h WHERE first OR n < 3"))
def fingerprint_dedup(s, d):
    return dedupe.first_of_fingerprint(mem(s, d), "user_id", F.desc("importance"), F.asc("id")).select("user_id", "id")


@query("s6_temporal_fingerprint", "SELECT doc_id, trim(regexp_replace('As of May 1, ' || text, '(?i)^\\s*as of [^,]*,\\s*', '')) AS content FROM documents WHERE text IS NOT NULL")
def temporal_fingerprint(s, d):
    x = F.concat(F.lit("As of May 1, "), F.col("text"))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", dedupe.strip_as_of(x).alias("content"))


@query("s7_ordered_facts")
def ordered_facts(s, d):
    m = mem(s, d)
    twice = m.unionByName(m.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000))
    return dedupe.ordered_facts(twice.withColumn("ord", F.col("id")), "user_id", 0.9, True)


@query("s8_majority", "SELECT source || '/' || n_chars % 30 AS fact, count(DISTINCT doc_id // 20 % 5) AS votes FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id // 20 % 5) >= 3")
def majority(s, d):
    """Documents as what five runs found: a fact is a source and a length class."""
    fact = F.concat("source", F.lit("/"), (F.col("n_chars") % 30).cast("string"))
    r = table(s, d, "documents").select(fact.alias("fact"), F.expr("doc_id div 20 % 5").alias("run"))
    return dedupe.majority(r, "fact", "run", 5)


COMP = "SELECT episode_id AS composite_id, list(id ORDER BY id) AS member_ids FROM memories GROUP BY episode_id"


def composites(s, d):
    return mem(s, d).groupBy(F.col("episode_id").alias("composite_id")).agg(F.sort_array(F.collect_list("id")).alias("member_ids"))


@query("s9_composite_coverage", M(f", c AS ({COMP}), e AS (SELECT composite_id, unnest(member_ids) AS id FROM c) SELECT composite_id, round(avg((id % 3 > 0)::INT), 6) AS coverage FROM e GROUP BY composite_id HAVING avg((id % 3 > 0)::INT) >= 0.6"))
def composite_coverage(s, d):
    return dedupe.soft_covered(mem(s, d).where("id % 3 > 0"), composites(s, d)).select("composite_id", F.round("coverage", 6).alias("coverage"))


@query("s10_stale_composites", M(f", c AS ({COMP}) SELECT composite_id FROM c WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.episode_id = c.composite_id AND m.deleted_at IS NOT NULL)"))
def stale_composites(s, d):
    return dedupe.fresh_composites(composites(s, d), mem(s, d).where("deleted_at IS NULL").select("id")).select("composite_id")


@query("s11_content_hash", "WITH k AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT hash FROM k WHERE hash IS NOT NULL)")
def content_hash(s, d):
    x = table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    known = x.where("doc_id % 2 = 0").select(F.sha2("content", 256).alias("hash")).distinct()
    return dedupe.new_content(x.where("doc_id % 2 = 1"), known).select("doc_id", "hash")


@query("s12_candidate_merge", M("SELECT id, max(s) AS similarity FROM (SELECT id, importance AS s FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, trust FROM memories WHERE id % 2 = 1 OR id % 3 = 0) GROUP BY id"))
def candidate_merge(s, d):
    m = mem(s, d)
    a = m.where("id % 2 = 0").select("id", F.col("importance").cast("double").alias("s"))
    return a.unionByName(m.where("id % 2 = 1 OR id % 3 = 0").select("id", F.col("trust").cast("double").alias("s"))).groupBy("id").agg(F.max("s").alias("similarity"))


@query("s14_entity_last_wins", "SELECT lower(source) AS name, arg_max(lang, doc_id) AS lang, min(doc_id) AS place FROM documents GROUP BY lower(source)")
def entity_last_wins(s, d):
    x = table(s, d, "documents").select("doc_id", "source", "lang")
    return dedupe.last_wins(x, "doc_id", F.lower("source")).select(F.lower("source").alias("name"), "lang", "place")


@query("g12_affinity_clusters")
def affinity_clusters(s, d):
    return cluster.affinity_clusters(mem(s, d), "user_id", threshold=0.3)


@query("g13_leader_clusters")
def leader_clusters(s, d):
    return cluster.leader_clusters(mem(s, d).withColumn("importance", F.col("importance").cast("double")), ["user_id", "episode_id"], threshold=0.1).select("user_id", "episode_id", "grp", "members", "importance")


@query("g16_episode_summary", "SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def episode_summary(s, d):
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("summary"))


@query("f9_injections", "SELECT doc_id, " + " OR ".join("regexp_matches(coalesce(text, ''), '" + p.replace("'", "''") + "')" for p in R.INJECTIONS.values()) + " AS flagged FROM documents")
def injections(s, d):
    return table(s, d, "documents").select("doc_id", R.any_of(F.coalesce("text", F.lit("")), list(R.INJECTIONS.values())).alias("flagged"))


@query("f10_anomalies", "SELECT doc_id, length(text) > 2000 AS too_long, (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::DOUBLE / greatest(length(text), 1) > 0.3 AS foreign_text, len(w) >= 10 AND most >= 5 AND most > 0.5 * len(w) AS repetition FROM (SELECT *, len(list_filter(w, lambda x: x = top)) AS most FROM (SELECT *, list_aggregate(w, 'mode') AS top FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)))")
def anomalies(s, d):
    a = X.anomalies(F.col("text"))
    rows = table(s, d, "documents").where("text IS NOT NULL").withColumn("a", a)
    return rows.select("doc_id", F.array_contains("a", "length").alias("too_long"), F.array_contains("a", "non_ascii").alias("foreign_text"), F.array_contains("a", "repetition").alias("repetition"))


@query("f11_trust_score", "SELECT doc_id, round(greatest(0.0, least(1.0, 1 - CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 0.2 END - least(0.3 * (doc_id % 4), 0.9) - 0.1 * (doc_id % 2))), 6)::DOUBLE AS trust FROM documents")
def trust(s, d):
    return table(s, d, "documents").select("doc_id", F.round(scoring.trust_score(F.col("source"), ["src1", "src2"], F.col("doc_id") % 4, F.col("doc_id") % 2), 6).alias("trust"))


@query("f12_source_kind", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'conversation' ELSE 'other' END AS kind FROM documents")
def source_kind(s, d):
    return table(s, d, "documents").select("doc_id", X.source_kind(F.col("source"), ["src1", "src2"]).alias("kind"))


@query("f13_chunks")
def chunks(s, d):
    return X.chunks(table(s, d, "documents"), "doc_id", "text").drop("content")


@query("f15_turn_windows")
def turn_windows(s, d):
    return X.turn_windows(table(s, d, "conversations"))


@query("f16_token_estimates", "SELECT doc_id, greatest(1, ceil(length(text) / 4))::BIGINT AS a, ceil(length(text) * 0.25)::BIGINT AS b FROM documents WHERE text IS NOT NULL")
def token_estimates(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", scoring.tokens(F.col("text")).alias("a"), scoring.tokens_or_none(F.col("text")).alias("b"))


@query("f17_headline", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:10], ' ') AS headline FROM documents WHERE text IS NOT NULL")
def headline(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.headline(F.col("text")).alias("headline"))


@query("f17b_overview")
def overview(s, d):
    return table(s, d, "documents").select("doc_id", X.overview(F.col("text")).alias("overview"))


STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"


@query("f18_entity_tokens", f"SELECT doc_id, list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({STOPS}, w)), regexp_extract_all(lower(text), '[a-z0-9]+[-_.][a-z0-9]+')))) AS tokens FROM documents WHERE text IS NOT NULL")
def entity_tokens(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.entity_tokens(F.col("text")).alias("tokens"))


@query("f23_conflict_keywords", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: NOT list_contains({STOPS}, w)))) AS n FROM documents WHERE text IS NOT NULL")
def conflict_keywords(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.keywords(F.col("text"))).alias("n"))


@query("f32_durations", f"SELECT event_id, floor(date_diff('day', ts::DATE, {T}::DATE) / 7.0 + 0.5)::BIGINT AS weeks FROM events")
def durations(s, d):
    return table(s, d, "events").select("event_id", X.duration(F.datediff(F.lit(NOW).cast("date"), F.to_date("ts")), "weeks").alias("weeks"))


@query("f37_namespace", "SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || '/' || lang AS namespace FROM documents")
def namespace(s, d):
    return table(s, d, "documents").select("doc_id", X.infer_namespace(F.col("source"), F.col("lang")).alias("namespace"))


@query("f40_injection_text", M("SELECT user_id, string_agg('<memory id=\"' || id || '\">' || replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</memory>', chr(10) ORDER BY id) AS text FROM memories GROUP BY user_id"))
def injection_text(s, d):
    return packaging.injection_text(mem(s, d).withColumn("rank", F.col("id")), "user_id")


@query("f41_tiers")
def tiers(s, d):
    return packaging.tiers(mem(s, d).withColumn("score", F.col("importance").cast("double")), "user_id", 2000).drop("text")


@query("f34_timeline", M("SELECT user_id, id, strftime(created_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1 AS current FROM memories"))
def timeline(s, d):
    return packaging.timeline(mem(s, d), "user_id").select("user_id", "id", F.substring("line", 1, 10).alias("day"), F.col("line").endswith(" [CURRENT]").alias("current"))


@query("f49_backoff", "SELECT event_id, least(60000.0, 500 * pow(2, event_id % 12))::DOUBLE AS wait_ms FROM events")
def backoff(s, d):
    return table(s, d, "events").select("event_id", scoring.backoff(F.col("event_id") % 12, 500, 60000).alias("wait_ms"))


@query("f50_costs", "SELECT event_type, round(sum(value * CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.2 END), 4) AS cost FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def costs(s, d):
    price = s.createDataFrame([("click", 0.1), ("view", 0.2)], "event_type string, price double")
    return table(s, d, "events").join(price, "event_type").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("price")), 4).alias("cost"))


@query("f52_citations", M("SELECT id, source_site, created_at::DATE AS date, importance FROM memories"))
def citations(s, d):
    c = packaging.citations(mem(s, d))
    return c.select("citation.id", "citation.source_site", "citation.date", F.col("citation.importance").cast("double").alias("importance"))


@query("v20_default_embedding")
def default_embedding(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.embed(F.col("text")).alias("embedding"))


@query("b2_overlay", M("SELECT id, CASE WHEN id % 10 = 0 THEN 'new ' || id ELSE content END AS content, CASE WHEN id % 10 = 0 THEN 0.5 ELSE importance END AS importance FROM memories"))
def overlay(s, d):
    m = mem(s, d).select("id", "content", F.col("importance").cast("double").alias("importance"))
    ch = m.where("id % 10 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("content"), F.lit(0.5).alias("importance"))
    return write.overlay(m, ch, "id")


@query("b3_metadata_merge", "SELECT event_id, (event_id % 5)::VARCHAR AS a, 'x' AS b FROM events")
def metadata_merge(s, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x"))
    patch = F.create_map(F.lit("a"), (F.col("event_id") % 5).cast("string"))
    return table(s, d, "events").select("event_id", write.merge_metadata(old, patch).alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("b4_soft_delete", M(f"SELECT id, CASE WHEN id % 9 = 0 THEN coalesce(deleted_at, {T}) ELSE deleted_at END AS deleted_at FROM memories"))
def soft_delete(s, d):
    m = mem(s, d)
    return write.soft_delete(m, m.where("id % 9 = 0").select("id"), F.lit(NOW).cast("timestamp_ntz")).select("id", "deleted_at")


@query("b4b_touch", M("SELECT id, access_count + (id % 9 = 0)::INT AS access_count FROM memories"))
def touch(s, d):
    m = mem(s, d)
    return write.touch(m, m.where("id % 9 = 0").select("id"), F.lit(NOW).cast("timestamp_ntz")).select("id", "access_count")


@query("b5_links", with_views(", st AS (SELECT entity_a AS lo, entity_b AS hi, 0.1::DOUBLE AS similarity FROM part_edges WHERE (entity_a + entity_b) % 3 > 0), b AS (SELECT entity_a AS lo, entity_b AS hi, max(n / 10.0)::DOUBLE AS similarity FROM part_edges WHERE (entity_a + entity_b) % 3 < 2 GROUP BY ALL) SELECT * FROM b UNION ALL SELECT * FROM st ANTI JOIN b USING (lo, hi)", "part_edges"))
def links(s, d):
    e = view(s, d, "part_edges")
    st = e.where("(entity_a + entity_b) % 3 > 0").select(F.col("entity_a").alias("lo"), F.col("entity_b").alias("hi"), F.lit(0.1).alias("similarity"))
    return write.upsert_links(st, e.where("(entity_a + entity_b) % 3 < 2").select(F.col("entity_b").alias("a"), F.col("entity_a").alias("b"), (F.col("n") / 10.0).cast("double").alias("similarity")))


@query("b6_relations", "SELECT user_id % 30 AS k, max(value) AS confidence, arg_max(event_id, (event_id % 2, event_id)) AS memory_id FROM events GROUP BY 1")
def relations(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 30).alias("k"), F.col("value").alias("confidence"), F.col("event_id").alias("memory_id"))
    return write.upsert_relations(e.where("memory_id % 2 = 0"), e.where("memory_id % 2 = 1"), "k")


@query("b7_insert_ignore", "SELECT min(event_id) AS event_id, user_id FROM events WHERE event_id % 5 = 0 GROUP BY user_id UNION ALL SELECT min(event_id), user_id FROM events WHERE event_id % 5 > 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 5 = 0) GROUP BY user_id")
def insert_ignore(s, d):
    e = table(s, d, "events").select("event_id", "user_id")
    first = lambda x: x.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id")
    return write.insert_ignore(first(e.where("event_id % 5 = 0")), first(e.where("event_id % 5 > 0")), "user_id")


@query("b8_newest_wins", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC) = 1")
def newest_wins(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts")
    return write.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "ts")


@query("b9_alias_merge", "SELECT doc_id, CASE WHEN lang = 'en' THEN ['EN'] ELSE ['EN', lang] END AS aliases FROM documents")
def alias_merge(s, d):
    a = F.array(F.lit("EN"))
    return table(s, d, "documents").select("doc_id", write.add_alias(a, F.array(F.lit("en")), F.col("lang")).alias("aliases"))


GONE = "(SELECT id FROM memories WHERE source_site = 'src3')"


@query(
    "b10_cascade",
    M(
        f"SELECT (SELECT count(*) FROM memories WHERE source_site <> 'src3') AS memories, (SELECT count(*) FROM versions WHERE version_id NOT IN {GONE}) AS versions, (SELECT count(DISTINCT claim_id) FROM versions WHERE version_id NOT IN {GONE}) AS claims,"
        f" (SELECT count(*) FROM part_edges WHERE entity_a NOT IN {GONE} AND entity_b NOT IN {GONE}) AS links, (SELECT count(*) FROM part_edges WHERE memory_id NOT IN {GONE}) AS bridges", "versions", "part_edges",
    ),
)
def cascade(s, d):
    v = view(s, d, "versions").withColumn("memory_id", F.col("version_id"))
    e = view(s, d, "part_edges")
    t = write.cascade_delete({"memories": mem(s, d), "versions": v, "claims": v.select("claim_id").distinct(), "links": e.select(F.col("entity_a").alias("lo"), F.col("entity_b").alias("hi")), "bridges": e.select("memory_id", F.col("entity_a").alias("entity_id")), "episodes": view(s, d, "episodes")}, "src3")
    n = lambda k: t[k].agg(F.count(F.lit(1)).alias(k))
    return n("memories").crossJoin(n("versions")).crossJoin(n("claims")).crossJoin(n("links")).crossJoin(n("bridges"))


@query("b12_wipe_user", M("SELECT count(*) AS n FROM memories WHERE user_id <> 3"))
def wipe_user(s, d):
    return mem(s, d).where("user_id <> 3").agg(F.count(F.lit(1)).alias("n"))


@query("b13_rekey", "SELECT DISTINCT CASE WHEN user_id = 1 THEN 2 ELSE user_id END AS user_id, event_type FROM events")
def rekey(s, d):
    return write.rekey(table(s, d, "events").select("user_id", "event_type"), "user_id", 1, 2, "user_id", "event_type")


@query("b17_status_machine", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'view' THEN 'complete' END AS next FROM events")
def status_machine(s, d):
    legal = {("pending", "start"): "running", ("running", "finish"): "complete"}
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running").otherwise("failed")
    event = F.when(F.col("event_type") == "click", "start").otherwise("finish")
    return table(s, d, "events").select("event_id", write.transition(state, event, legal).alias("next"))


@query("u9_version_chain", with_views("SELECT version_id, valid_to, superseded_by, previous_version, superseded_by IS NULL AS current FROM versions", "versions"))
def version_chain(s, d):
    v = view(s, d, "versions").select("version_id", "claim_id", "valid_from")
    return write.scd2(v, "claim_id", "valid_from").select("version_id", "valid_to", "superseded_by", "previous_version", "current")


def mentions(s, d):
    """Memories as mentions of entities: the first words are the name; some are named again in capitals, by an alias, or by a new name with almost the same vector."""
    words = F.array_join(F.slice(F.split(F.trim(F.coalesce("content", F.lit(""))), r"\s+"), 1, 3), " ")
    none = F.array().cast("array<string>")
    first = mem(s, d).select("id", "user_id", F.col("topic").cast("string").alias("entity_type"), words.alias("name"), F.when(F.col("id") % 7 == 0, F.array(F.concat(F.lit("Alias "), F.col("id")))).otherwise(none).alias("aliases"), F.col("embedding").cast("array<double>").alias("embedding"))
    capitals = first.where("id % 3 = 0").select(F.col("id") + 1_000_000, "user_id", "entity_type", F.concat(F.upper("name"), F.lit("!")), none, F.reverse("embedding"))
    turned = V.blend("embedding", F.reverse("embedding"), 0.8)
    anew = first.where("id % 5 = 0").select(F.col("id") + 2_000_000, "user_id", "entity_type", F.concat(F.lit("Entity "), F.col("id")), none, turned)
    alias = first.where("id % 7 = 0").select(F.col("id") + 3_000_000, "user_id", "entity_type", F.concat(F.lit("alias  "), F.col("id")), none, F.reverse("embedding"))
    return first.union(capitals).union(anew).union(alias).withColumn("ord", F.col("id"))


@query("u11_entity_resolution")
def entity_resolution(s, d):
    return write.resolve_mentions(mentions(s, d))


@query("u10_beliefs")
def beliefs(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 40).alias("target"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", 0.1).otherwise(-0.05).alias("delta"))
    return write.fold_beliefs(e, "target").select("target", F.round("confidence", 6).alias("confidence"))


@query("u17_auto_resolve", "SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 'auto_resolved' ELSE 'open' END AS state FROM events")
def auto_resolve(s, d):
    e = table(s, d, "events").select("event_id", F.lit("open").alias("state"), F.col("ts").alias("resolve_after"))
    return write.auto_resolve(e, F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "state")


@query("u21_first_mentions", "SELECT conv_id, topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn, topic) - 1 AS position FROM (SELECT conv_id, role AS topic, min(turn) AS turn FROM conversations GROUP BY ALL)")
def first_mentions(s, d):
    g = table(s, d, "conversations").groupBy("conv_id", F.col("role").alias("topic")).agg(F.min("turn").alias("turn"))
    return g.select("conv_id", "topic", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "topic")) - 1).alias("position"))


@query("u24_dimension_check", "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_check(s, d):
    return table(s, d, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("q_tumbling_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hours(s, d):
    w = queues.windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q1_drained_queue", "SELECT event_id FROM events WHERE value >= 1")
def drained_queue(s, d):
    """A stream over the events, drained with its failures dead-lettered; the result is what was processed."""
    out = f"{shared_dir(s)}/memlake/queue-{uuid.uuid4().hex}"
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    split = lambda df: (df.where("value >= 1").select("event_id"), df.where("value < 1").select("event_id"))
    queues.drain(stream, split, f"{out}/done", f"{out}/dead", f"{out}/checkpoint").awaitTermination()
    return s.read.parquet(f"{out}/done").select("event_id")
