"""Queries over search, fusion, re-ranking and graph ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import predicates as P
from memlake.functions import scoring, vectors
from memlake.functions import rules as R
from memlake.operators import conflict, fusion, graph, lineage, ranking, search, textindex
from memlake.plans.core import ACTIVE, M, T, mem
from memlake.plans.rules import has
from memlake.registry import query
from memlake.sources.tables import NOW, cut, table, view, with_views

#: The query vector is the embedding of vector 0: a scalar subquery, so that no data comes to the driver.
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def near(s, d, df, out="similarity"):
    """df with the cosine to the embedding of vector 0."""
    q = table(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn(out, vectors.cosine("embedding", "_q")).drop("_q")


def vec0(s, d):
    """The query vector as a list, for operators that take one."""
    return list(table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


COS = "list_dot_product(m.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(m.embedding::DOUBLE[], m.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e)))"
QCTE = f", q AS (SELECT {Q0}::DOUBLE[] AS e), sim AS (SELECT m.*, {COS} AS similarity, exp(-(epoch_us({T}) - epoch_us(m.last_accessed_at)) / 1e6 / 2592000.0) AS rec FROM memories m, q)"
SCORED = QCTE + ", sc AS (SELECT *, (2 * similarity + importance + rec) * trust AS score, (2 * similarity + CASE WHEN similarity >= 0.3 THEN importance + rec ELSE 0 END) * trust AS ranking_score, greatest(0.0, least(1.0, similarity)) AS relevance FROM sim)"


@query("v1_scored_topk", M(SCORED + f" SELECT id, round(similarity, 6) AS similarity, round(score, 6) AS score, round(ranking_score, 6) AS ranking_score, round(relevance, 6) AS relevance FROM sc WHERE {ACTIVE} ORDER BY sc.ranking_score DESC, id LIMIT 10"))
def scored_topk(s, d):
    out = search.vector_search(mem(s, d).where(P.active()), vec0(s, d), 10, NOW)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("similarity", "score", "ranking_score", "relevance")])


@query("v3_two_stage")
def two_stage(s, d):
    return search.two_stage(mem(s, d), vec0(s, d), 10, NOW).select("id", F.round("similarity", 6).alias("similarity"))


@query("v4_approximate_candidates")
def approximate_candidates(s, d):
    m = mem(s, d).select("id", "embedding")
    q = m.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.candidates_by_bands(m, q, 64, 0.3, bands=24, bits=4).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("v5_workspace_search", M(SCORED + " SELECT id, round(ranking_score, 6) AS ranking_score FROM sc WHERE workspace_id = 'w0' AND deleted_at IS NULL AND expired_at IS NULL AND status = 'active' AND (agent_id IS NULL OR agent_id <> 'a1') ORDER BY sc.ranking_score DESC, id LIMIT 10"))
def workspace_search(s, d):
    m = mem(s, d).where(P.active(workspace="w0") & P.agent_scope("others", "a1"))
    return search.vector_search(m, vec0(s, d), 10, NOW).select("id", F.round("ranking_score", 6).alias("ranking_score"))


WORDS = "list_transform(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: regexp_replace(w, '(ing|ed|es|s)$', ''))"
KW = f"SELECT *, least(1.0, len(list_filter({WORDS}, lambda w: list_contains(['the', 'of'], w)))::DOUBLE / greatest(1, len({WORDS}))) AS rank_score FROM memories WHERE list_has_all({WORDS}, ['the', 'of'])"


_indexes: dict[tuple[str, str], textindex.TextIndex] = {}


def memory_index(s, d):
    """The memories' text index, built once for a folder of tables and session."""
    at = (s.sparkContext.applicationId, d)
    if at not in _indexes:
        _indexes[at] = textindex.build(mem(s, d).select("id", "content", "importance", "user_id"), keep=("importance", "user_id"))
    return _indexes[at]


def found(s, d, terms):
    """Keyword hits of that index."""
    return textindex.matches(s, memory_index(s, d), terms)


@query("v6_keyword_search", M(f", k AS ({KW}) SELECT id, round(rank_score, 6) AS rank_score FROM k ORDER BY k.rank_score DESC, importance DESC, id LIMIT 10"))
def keyword_search(s, d):
    return search.top_k(found(s, d, ["the", "of"]), 10, *search.by_words()).select("id", F.round("rank_score", 6).alias("rank_score"))


RRF = "coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + fr), 0)"
HYBRID = SCORED + f", k AS ({KW} ORDER BY rank_score DESC, importance DESC, id LIMIT 40), v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS vr FROM sc ORDER BY similarity DESC, id LIMIT 40), f AS (SELECT id, row_number() OVER (ORDER BY rank_score DESC, importance DESC, id) AS fr FROM k), u AS (SELECT id, {RRF} AS rrf FROM v FULL JOIN f USING (id))"


@query("v7_hybrid", M(HYBRID + " SELECT id, round(ranking_score + 0.8 * rrf, 6) AS ranking_score FROM sc JOIN u USING (id) ORDER BY ranking_score + 0.8 * rrf DESC, id LIMIT 10".replace("ORDER BY ranking_score", "ORDER BY sc.ranking_score")))
def hybrid(s, d):
    return search.hybrid_search(mem(s, d), vec0(s, d), ["the", "of"], 10, NOW, found=found(s, d, ["the", "of"])).select("id", F.round("ranking_score", 6).alias("ranking_score"))


FACT_SQL = QCTE + ", v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS vr FROM sim ORDER BY similarity DESC, id LIMIT 60), k AS (" + KW + " ORDER BY rank_score DESC, importance DESC, id LIMIT 60), f AS (SELECT id, row_number() OVER (ORDER BY rank_score DESC, importance DESC, id) AS fr FROM k), u AS (SELECT id, " + RRF + " AS rrf FROM v FULL JOIN f USING (id)) SELECT user_id AS parent, round(max(similarity), 6) AS similarity, round(max(rrf), 6) AS rrf, list(id ORDER BY similarity + rrf DESC, id)[1:3] AS facts FROM sim JOIN u USING (id) GROUP BY user_id"


@query("v8_fact_hybrid", M(FACT_SQL))
def fact_hybrid(s, d):
    f = mem(s, d).select(F.col("id").alias("fact_id"), F.col("user_id").alias("parent"), "content", "embedding", "importance")
    return search.fact_hybrid(f, vec0(s, d), ["the", "of"], 10, found=found(s, d, ["the", "of"])).select("parent", F.round("similarity", 6).alias("similarity"), F.round("rrf", 6).alias("rrf"), "facts")


@query("v9_topic_search", M(QCTE + " SELECT id, round(similarity, 6) AS similarity FROM sim WHERE topic IS NOT NULL ORDER BY sim.similarity DESC, id LIMIT 8"))
def topic_search(s, d):
    return near(s, d, mem(s, d).where("topic IS NOT NULL")).orderBy(F.desc("similarity"), "id").limit(8).select("id", F.round("similarity", 6).alias("similarity"))


@query("v10_recap_search", M(QCTE + " SELECT user_id, id, round(similarity, 6) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim.similarity DESC, id) <= 3"))
def recap_search(s, d):
    return search.top_k(near(s, d, mem(s, d)), 3, F.desc("similarity"), F.asc("id"), by=("user_id",)).select("user_id", "id", F.round("similarity", 6).alias("similarity"))


@query("v11_hierarchical")
def hierarchical(s, d):
    m = mem(s, d).withColumn("topic", F.concat_ws("/", F.col("user_id").cast("string"), F.col("topic").cast("string")))
    mean = lambda *by: m.select(*by, F.posexplode("embedding").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding"))
    top = mean("user_id").select(F.lit(0).alias("level"), F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string").alias("parent"), "embedding")
    mid = mean("user_id", "topic").select(F.lit(1).alias("level"), F.col("topic").alias("key"), F.col("user_id").cast("string").alias("parent"), "embedding")
    return search.hierarchical(m, top.unionByName(mid), vec0(s, d)).select("id", "user_id", "topic")


@query("v12_entity_search", M(QCTE + " SELECT id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.2"))
def entity_search(s, d):
    return near(s, d, mem(s, d)).where("similarity >= 0.2").select("id", F.round("similarity", 6).alias("similarity"))


@query("v13_as_of_search", M(f"{QCTE} SELECT id, round(2 * similarity + importance + exp(-(epoch_us({T}) - epoch_us(created_at)) / 1e6 / 2592000.0), 6) AS score FROM sim WHERE created_at <= TIMESTAMP '2024-01-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15') ORDER BY score DESC, id LIMIT 10"))
def as_of_search(s, d):
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    m = near(s, d, mem(s, d).where((F.col("created_at") <= at) & (F.col("expired_at").isNull() | (F.col("expired_at") > at))))
    rec = scoring.recency(F.col("created_at"), F.lit(NOW).cast("timestamp"))
    return m.select("id", F.round(2 * F.col("similarity") + F.col("importance").cast("double") + rec, 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


KSIM = "CASE WHEN contains(lower(content), 'the of') THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(content), 'erth') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(content), 'thinghere') THEN 1.5 ELSE 0 END"


@query("v14_keyword_similarity", M(f"SELECT id, round(CASE WHEN {KSIM} > 0 THEN least(0.89, 0.45 + 0.44 * ({KSIM}) / 5.0) ELSE 0 END, 6) AS kw FROM memories"))
def keyword_similarity(s, d):
    return mem(s, d).select("id", F.round(search.keyword_similarity(F.col("content"), ["the of", "erth", "thinghere"]), 6).alias("kw"))


@query("v15_keyword_boost", M(f"{QCTE}, b AS (SELECT *, CASE WHEN {KSIM} > 0 THEN least(0.89, 0.45 + 0.44 * ({KSIM}) / 5.0) ELSE 0 END AS kw FROM sim) SELECT id, round(greatest(similarity, kw), 6) AS similarity, round(importance + kw * 0.5, 6) AS score FROM b WHERE kw > 0"))
def keyword_boost(s, d):
    m = near(s, d, mem(s, d)).withColumn("kw", search.keyword_similarity(F.col("content"), ["the of", "erth", "thinghere"])).where("kw > 0")
    return m.select("id", F.round(F.greatest("similarity", "kw"), 6).alias("similarity"), F.round(F.col("importance").cast("double") + F.col("kw") * 0.5, 6).alias("score"))


@query("v16_fetch_by_ids", M(SCORED + " SELECT id, round(score, 6) AS score FROM sc WHERE id IN (5, 50, 150, 24)"))
def fetch_by_ids(s, d):
    return search.scored(mem(s, d).where(F.col("id").isin(5, 50, 150, 24)), vec0(s, d), NOW).select("id", F.round("score", 6).alias("score"))


@query("v17_metrics", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e), 6) AS dot, round(list_distance(embedding::DOUBLE[], e), 6) AS euclid, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], e), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM embeddings, q")
def metrics(s, d):
    e = table(s, d, "embeddings")
    x = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q"))))
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.select("vec_id", r(vectors.dot("embedding", "q"), "dot"), r(vectors.euclidean("embedding", "q"), "euclid"), r(vectors.manhattan("embedding", "q"), "manhattan"))


@query("v18_local_search", M(f"{QCTE} SELECT id, round(least(1.0, similarity * CASE WHEN length(content) < 500 THEN 1.1 WHEN length(content) > 2000 THEN 0.9 ELSE 1.0 END * CASE WHEN (epoch_us({T}) - epoch_us(created_at)) / 1e6 < 7 * 86400 THEN 1.05 ELSE 1.0 END), 6) AS reranked FROM sim WHERE similarity >= 0.1"))
def local_search(s, d):
    return search.heuristic_rerank(near(s, d, mem(s, d)).where("similarity >= 0.1"), NOW).select("id", F.round("reranked", 6).alias("reranked"))


@query("v19_weighted_ranking", M("SELECT id, round(CASE WHEN agent_id IS NULL THEN (0.7 * importance) / 0.7 ELSE (0.7 * importance + 0.3 * trust) / 1.0 END, 6) AS combined, round((importance - min(importance) OVER (PARTITION BY user_id)) / (max(importance) OVER (PARTITION BY user_id) - min(importance) OVER (PARTITION BY user_id)), 6) AS scaled FROM memories"))
def weighted_ranking(s, d):
    m = mem(s, d).withColumn("importance", F.col("importance").cast("double"))
    scores = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("importance"), F.when(F.col("agent_id").isNotNull(), F.col("trust").cast("double"))))
    m = fusion.min_max(m.withColumn("combined", fusion.weighted_criteria(scores, {"a": 0.7, "b": 0.3})), "importance", "scaled", ("user_id",))
    return m.select("id", F.round("combined", 6).alias("combined"), F.round("scaled", 6).alias("scaled"))


@query("j16_near_pairs", M("SELECT a.id AS a, b.id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM memories a JOIN memories b ON a.topic = b.topic AND a.id < b.id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3"))
def near_pairs(s, d):
    return search.near_pairs(mem(s, d).select("id", "embedding", "topic"), 0.3, "topic").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("j17_link_candidates")
def link_candidates(s, d):
    p = search.near_pairs(mem(s, d).select("id", "embedding", "user_id"), 0.25, "user_id")
    both = graph.both_ways(p, "a", "b")
    return search.top_k(both, 10, F.desc("similarity"), F.asc("dst"), by=("src",)).select("src", "dst", F.round("similarity", 6).alias("similarity"))


CH = ", ch AS (SELECT 'semantic' AS channel, 1.2 AS weight, 0 AS ord, id, importance AS score FROM memories WHERE id % 2 = 0 UNION ALL SELECT 'entity', 1.3, 1, id, trust FROM memories WHERE id % 2 = 1 OR id % 3 = 0), rk AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS rank FROM ch)"


@query("r1_rank_fusion", M(CH + " SELECT id, round(sum(weight / (60.0 + rank)), 6) AS fused, round(arg_min(score, ord), 6) AS score FROM rk WHERE rank <= 60 GROUP BY id"))
def rank_fusion(s, d):
    m = mem(s, d)
    a = m.where("id % 2 = 0").select(F.lit("semantic").alias("channel"), F.lit(fusion.CHANNELS["semantic"]).alias("weight"), F.lit(0).alias("ord"), "id", F.col("importance").cast("double").alias("score"))
    b = m.where("id % 2 = 1 OR id % 3 = 0").select(F.lit("entity").alias("channel"), F.lit(fusion.CHANNELS["entity"]).alias("weight"), F.lit(1).alias("ord"), "id", F.col("trust").cast("double").alias("score"))
    ranked = a.unionByName(b).withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "id"))).where("rank <= 60")
    return fusion.rrf(ranked).select("id", F.round("fused", 6).alias("fused"), F.round("score", 6).alias("score"))


@query("r3_stage_merge", M("SELECT id, round(max(k), 6) AS score FROM (SELECT id, importance AS k FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, trust * 0.92 FROM memories WHERE id % 2 = 1 OR id % 3 = 0) GROUP BY id"))
def stage_merge(s, d):
    row = lambda c: ["id", F.col(c).cast("double").alias("score"), F.lit(None).cast("double").alias("ranking_score")]
    m = mem(s, d)
    return fusion.stage_merge(m.where("id % 2 = 0").select(*row("importance")), m.where("id % 2 = 1 OR id % 3 = 0").select(*row("trust")), 0.92).select("id", F.round("score", 6).alias("score"))


@query("r4_repair_accept", M("SELECT round(a, 6) AS before, round(b, 6) AS after, NOT (a > 0.6 AND b < a) AND b - a >= 0.01 AND b >= 0.3 AS accepted FROM (SELECT max(importance) FILTER (id % 2 = 0) * 0.5 AS a, max(trust) FILTER (id % 2 = 1 OR id % 3 = 0) AS b FROM memories)"))
def repair_accept(s, d):
    m = mem(s, d)
    out = fusion.repair_accepted(m.where("id % 2 = 0").select((F.col("importance").cast("double") * 0.5).alias("score")), m.where("id % 2 = 1 OR id % 3 = 0").select(F.col("trust").cast("double").alias("score")))
    return out.select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "accepted")


@query("r5_mmr")
def mmr(s, d):
    rows = near(s, d, mem(s, d)).select("user_id", "id", F.col("similarity").alias("score"), "embedding")
    cand = search.top_k(rows.withColumnRenamed("user_id", "query_id"), 60, F.desc("score"), F.asc("id"), by=("query_id",))
    return fusion.mmr(cand, 5)


def parts_both_ways(s, d):
    """Edges of parts that are ordered together, in both directions; the join that makes them runs once."""
    return graph.both_ways(cut(view(s, d, "part_edges").select("entity_a", "entity_b")), "entity_a", "entity_b")


def _ppr_sql(rounds: int) -> str:
    out = with_views(
        ", a AS (SELECT entity_a AS s, entity_b AS t FROM part_edges UNION ALL SELECT entity_b, entity_a FROM part_edges), n1 AS (SELECT t AS n FROM a WHERE s IN (1, 2) UNION SELECT unnest([1, 2])), n2 AS (SELECT t AS n FROM a JOIN n1 ON s = n UNION SELECT n FROM n1),"
        " o AS MATERIALIZED (SELECT s, t, count(*) OVER (PARTITION BY s) AS deg FROM a WHERE s IN (SELECT n FROM n2) AND t IN (SELECT n FROM n2)), r0 AS (SELECT 1::BIGINT AS n, 0.5::DOUBLE AS p UNION ALL SELECT 2, 0.5)", "part_edges",
    )
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT n, sum(p)::DOUBLE AS p FROM (SELECT o.t AS n, 0.5 * sum(r.p / o.deg) AS p FROM o JOIN r{k} r ON o.s = r.n GROUP BY o.t UNION ALL SELECT n, 0.5 * p FROM r0) GROUP BY n)"
    return out + f" SELECT n AS node, round(p, 6) AS rank FROM r{rounds} WHERE round(p, 6) > 0 AND n NOT IN (1, 2)"


@query("r6_personalised_pagerank", _ppr_sql(20))
def personalised_pagerank(s, d):
    e = parts_both_ways(s, d)
    seeds = s.createDataFrame([(1, 1.0), (2, 1.0)], "node long, weight double")
    return graph.pagerank(e, seeds).select("node", F.round("rank", 6).alias("rank")).where("rank > 0")


@query("r6b_activation", with_views(", e AS (SELECT entity_a AS s, entity_b AS t FROM part_edges UNION ALL SELECT entity_b, entity_a FROM part_edges), a1 AS (SELECT n, max(v) AS v FROM (SELECT 1::BIGINT AS n, 1.0 AS v UNION ALL SELECT t, 0.7 FROM e WHERE s = 1) GROUP BY n), a2 AS (SELECT n, max(v) AS v FROM (SELECT * FROM a1 UNION ALL SELECT t, 0.7 * v FROM e JOIN a1 ON s = n) GROUP BY n), a3 AS (SELECT n, max(v) AS v FROM (SELECT * FROM a2 UNION ALL SELECT t, 0.7 * v FROM e JOIN a2 ON s = n) GROUP BY n) SELECT n AS node, round(v, 6)::DOUBLE AS activation FROM a3", "part_edges"))
def activation(s, d):
    e = parts_both_ways(s, d)
    return graph.spread(e, s.createDataFrame([(1, 1.0)], "node long, weight double")).select("node", F.round("activation", 6).alias("activation"))


@query("r8_protected", M("SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rank FROM (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (id % 7 = 0) DESC, importance DESC, id) <= 8)"))
def protected(s, d):
    rows = mem(s, d).select("user_id", "id", F.col("importance").cast("double").alias("score"), (F.col("id") % 7 == 0).alias("protected"))
    return fusion.protect(rows, 8, "user_id").select("user_id", "id", "rank")


MOVED = "CASE WHEN regexp_matches(lower(content), '(switched|migrated|moved|changed|replaced)') THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(lower(content), '(now|current|currently|latest)') THEN 0.45 ELSE 0 END - CASE WHEN regexp_matches(lower(content), '(previously|formerly|used to|no longer)') THEN 0.6 ELSE 0 END"


@query("r9_current_state", M(f"SELECT id, round(importance + 2.5 * (count(*) OVER (PARTITION BY user_id) - (row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) - 1)) / count(*) OVER (PARTITION BY user_id) + {MOVED}, 6) AS adjusted FROM memories"))
def current_state(s, d):
    m = mem(s, d).withColumn("score", F.col("importance").cast("double"))
    return fusion.current_state(m, "user_id").select("id", F.round("adjusted", 6).alias("adjusted"))


@query("r11_concise", M(", x AS (SELECT *, length(content) AS n, list_sort(list(length(content)) OVER (PARTITION BY user_id))[count(*) OVER (PARTITION BY user_id) // 2 + 1] AS med FROM memories) SELECT id, round(CASE WHEN n > med AND n > 150 THEN importance * (1 - 0.15 * least(1.0, (n - med)::DOUBLE / greatest(med, 1))) ELSE importance END, 6) AS adjusted FROM x"))
def concise(s, d):
    m = mem(s, d).withColumn("score", F.col("importance").cast("double"))
    return fusion.concise(m, "user_id").select("id", F.round("adjusted", 6).alias("adjusted"))


@query("r12_month_boost", M("SELECT id, round(importance + CASE WHEN month(created_at) = 1 AND year(created_at) = 2024 THEN 1 ELSE 0 END, 6) AS adjusted FROM memories"))
def month_boost(s, d):
    return fusion.month_boost(mem(s, d).withColumn("score", F.col("importance").cast("double")), 1, 2024).select("id", F.round("adjusted", 6).alias("adjusted"))


@query("r13_state_rerank", M("SELECT id, round(importance + CASE WHEN expired_at IS NOT NULL THEN -0.1 WHEN state_key IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS adjusted FROM memories"))
def state_rerank(s, d):
    state = F.when(F.col("expired_at").isNotNull(), "past").when(F.col("state_key").isNotNull(), "current")
    return mem(s, d).select("id", F.round(fusion.state_rerank(F.col("importance").cast("double"), state), 6).alias("adjusted"))


@query("r15_model_rerank")
def model_rerank(s, d):
    rows = search.top_k(near(s, d, mem(s, d), "score"), 20, F.desc("score"), F.asc("id"), by=("user_id",)).withColumnRenamed("user_id", "query_id")
    return fusion.rerank(rows, lambda texts: [len(set(t.split())) / 100 - 1 for t in texts]).select("query_id", "id", F.round("reranked", 6).alias("reranked"))


@query("r17_recency_sort", M("SELECT user_id, id, created_at FROM memories QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 10"))
def recency_sort(s, d):
    return search.top_k(mem(s, d), 10, F.desc("created_at"), F.asc("id"), by=("user_id",)).select("user_id", "id", "created_at")


_TIER = f"CASE WHEN {has('content', *R.TIER_1)} THEN 1 WHEN {has('content', *R.TIER_2)} THEN 2 ELSE 3 END"


@query("r18_session_order", M(f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY first_at, episode_id, tier, created_at, id) AS place, tier FROM (SELECT *, min(created_at) FILTER (WHERE tier = best) OVER (PARTITION BY user_id, episode_id) AS first_at FROM (SELECT *, min(tier) OVER (PARTITION BY user_id, episode_id) AS best FROM (SELECT *, {_TIER} AS tier FROM memories)))"))
def session_order(s, d):
    return ranking.by_session(mem(s, d), "user_id", F.col("content")).select("user_id", "id", "place", "tier")


@query("r19_answer_trim", M(f"SELECT user_id, id FROM memories QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_TIER} < 3 DESC, importance DESC, id) <= 6"))
def answer_trim(s, d):
    m = mem(s, d).withColumn("bears", R.answer_bearing(F.col("content")))
    return search.top_k(m, 6, F.desc("bears"), F.desc("importance"), F.asc("id"), by=("user_id",)).select("user_id", "id")


@query("r20_adaptive_limit", "SELECT 'simple' AS label, 5 AS k UNION ALL SELECT 'multi-hop', 12 UNION ALL SELECT 'aggregation', 25")
def adaptive_limit(s, d):
    return s.createDataFrame([(x, fusion.adaptive_limit(x)) for x in ("simple", "multi-hop", "aggregation")], "label string, k int")


@query("r21_iterative")
def iterative(s, d):
    """A second search by a blend of the query and the best hit, its scores at 0.72."""
    m, q = mem(s, d).where(P.active()), vec0(s, d)
    one = search.vector_search(m, q, 10, NOW)
    seed = one.orderBy(F.desc("ranking_score"), "id").limit(1).select(F.col("embedding").alias("_s"))
    blended = seed.select(vectors.blend(vectors.literal(q), "_s", 0.6).alias("_q"))
    two = m.crossJoin(F.broadcast(blended)).withColumn("similarity", vectors.cosine("embedding", "_q")).orderBy(F.desc("similarity"), "id").limit(10)
    cols = lambda df, c: df.select("id", F.col(c).alias("score"), F.lit(None).cast("double").alias("ranking_score"))
    return fusion.stage_merge(cols(one, "similarity"), cols(two, "similarity"), 0.72).select("id", F.round("score", 6).alias("score"))


@query("r24_trust_multiplier", M("SELECT id, round(importance * trust, 6) AS score FROM memories"))
def trust_multiplier(s, d):
    return mem(s, d).select("id", F.round(F.col("importance").cast("double") * F.col("trust").cast("double"), 6).alias("score"))


@query("f6_vector_math", "WITH c AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL) SELECT label, list(round(x, 5) ORDER BY i)[1:4] AS head, round(sum(x * x) FILTER (i % 6 = 0), 6) AS sampled FROM c GROUP BY label")
def vector_math(s, d):
    c = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    e = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("e"))
    sub = vectors.subsample("e")
    return e.select("label", F.slice(F.transform("e", lambda x: F.round(x, 5)), 1, 4).alias("head"), F.round(vectors.dot(sub, sub), 6).alias("sampled"))


# New facts against memories ----------------------------------------------------------------------

#: The stored vectors are far apart; this is the cosine that a few of them reach.
LEAST = 0.25


def new_facts(s, d):
    """Every fourth memory as a fact that comes in, with its slot."""
    m = mem(s, d).where("id % 4 = 0")
    text = F.coalesce("content", F.lit(""))
    return m.select(
        F.col("id").alias("fact_id"), "user_id", text.alias("fact"), "embedding", F.col("state_key").alias("slot"), F.col("importance").cast("double").alias("importance"),
        ((F.col("id") % 10) / 10.0).cast("double").alias("confidence"), R.fact_keywords(text).alias("keywords"), text.alias("updated"),
    )


def stored(s, d):
    """The other memories."""
    return mem(s, d).where("id % 4 <> 0").select("id", "user_id", "content", "embedding", F.col("state_key").alias("slot"), "created_at", "importance", "agent_id")


_STOPS = "[" + ", ".join("'" + w + "'" for w in (*R.UNCERTAIN, *R.GENERIC)) + "]"
_WORD = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(content, '')), '[a-z]{4,}'), lambda w: NOT list_contains(" + _STOPS + ", w)))"
_PARTS = (
    f", fact AS (SELECT id AS fact_id, user_id, embedding::DOUBLE[] AS v, state_key AS slot, unnest({_WORD}) AS word FROM memories WHERE id % 4 = 0), fact1 AS (SELECT id AS fact_id, user_id, embedding::DOUBLE[] AS v, state_key AS slot FROM memories WHERE id % 4 = 0),"
    f" mem AS (SELECT id, user_id, embedding::DOUBLE[] AS v, state_key AS slot, created_at, {_WORD} AS words FROM memories WHERE id % 4 <> 0), memw AS (SELECT id, user_id, unnest(words) AS word FROM mem),"
    f" n AS (SELECT fact_id, m.id, list_cosine_similarity(f.v, m.v) AS similarity FROM fact1 f JOIN mem m USING (user_id) WHERE list_cosine_similarity(f.v, m.v) >= {LEAST} QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY similarity DESC, m.id) <= 3),"
    " t AS (SELECT fact_id, sum(CASE WHEN length(word) >= 8 THEN 1.5::DOUBLE ELSE 1 END) AS total FROM fact GROUP BY fact_id),"
    " g AS (SELECT f.fact_id, m.id, sum(CASE WHEN length(f.word) >= 8 THEN 1.5::DOUBLE ELSE 1 END) AS got FROM fact f JOIN memw m ON f.user_id = m.user_id AND f.word = m.word GROUP BY f.fact_id, m.id),"
    " w AS (SELECT g.fact_id, g.id, least(0.89::DOUBLE, 0.45::DOUBLE + 0.44::DOUBLE * got / total) AS similarity FROM g JOIN t USING (fact_id) QUALIFY row_number() OVER (PARTITION BY g.fact_id ORDER BY similarity DESC, g.id) <= 5),"
    " h AS (SELECT user_id, slot, id FROM mem WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY created_at DESC, id DESC) = 1),"
    " s AS (SELECT fact_id, h.id, 1.0::DOUBLE AS similarity FROM fact1 f JOIN h ON f.user_id = h.user_id AND f.slot = h.slot),"
)


@query("u1_conflict_candidates", M(_PARTS + " a AS (SELECT *, FALSE AS by_slot FROM n UNION ALL SELECT *, FALSE FROM w UNION ALL SELECT *, TRUE FROM s) SELECT fact_id, id, round(max(similarity), 6) AS similarity, bool_or(by_slot) AS by_slot FROM a GROUP BY fact_id, id"))
def conflict_candidates(s, d):
    c = lineage.candidates(new_facts(s, d), stored(s, d), least=LEAST)
    return c.select("fact_id", "id", F.round("similarity", 6).alias("similarity"), "by_slot")


def decisions(s, d):
    facts, memories = new_facts(s, d), stored(s, d)
    return lineage.decided(facts, memories, lineage.candidates(facts, memories, least=LEAST))


@query("u3_decisions")
def fact_decisions(s, d):
    """Proposed and final action of each fact on its own candidates, and what executing it does."""
    x = decisions(s, d).withColumn("network", F.lit("experience")).withColumn("target_confidence", F.lit(None).cast("double"))
    return conflict.execute(x, preserve=False).select("fact_id", "given", "action", "target_id", "outcome", F.array_join("effects", ",").alias("effects"))


@query("u8_lineage")
def lineage_rows(s, d):
    return lineage.lineage(decisions(s, d))


@query("u8b_backfilled_lineage", M(", e AS (SELECT user_id, id, sha256('claim|' || user_id || '|' || id)[1:32] AS claim, sha256('version|' || user_id || '|' || id || '|backfill')[1:32] AS version FROM memories) SELECT user_id, 'version' AS \"table\", version AS id, claim AS ref FROM e UNION ALL SELECT user_id, 'claim', claim, version FROM e UNION ALL SELECT user_id, 'evidence', sha256('evidence|' || user_id || '|' || id || '|backfill')[1:32], version FROM e"))
def backfilled(s, d):
    return lineage.backfill(mem(s, d)).select("user_id", "table", "id", "ref")
