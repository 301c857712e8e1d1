"""Queries over question types, the client's chunks, and derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import chunking
from memlake.functions import rules as R
from memlake.operators import routing, summaries, textindex
from memlake.operators.search import top_k
from memlake.plans.core import mem
from memlake.plans.rules import S, has, said
from memlake.plans.search import memory_index
from memlake.registry import query
from memlake.sources import wiki
from memlake.sources.tables import table, with_views

_TYPE = (
    f"CASE WHEN {has('text', R.KU_STYLE, R.NUMERIC_COUNT)} THEN 'numeric_count' WHEN {has('text', R.EXACT_DATE)} THEN 'exact_date' WHEN {has('text', R.ORDERED_EXPLICIT)} OR ({has('text', R.ORDERED_HINT)} AND {has('text', R.ORDERED_NUMERIC)}) THEN 'ordered_list'"
    f" WHEN {has('text', R.CONTRADICTION)} THEN 'contradiction' WHEN {has('text', R.SUMMARY)} THEN 'summary' WHEN {has('text', R.PREFERENCE)} THEN 'preference' ELSE 'other' END"
)


def typed(s, d):
    return said(s, d).select("conv_id", "turn", "text", R.question_type(F.col("text")).alias("kind"))


@query("r26_channel_rules", S(f"SELECT conv_id, turn, kind = 'ordered_list' AS event_chain, kind IN ('contradiction', 'summary') AS observations, kind NOT IN ('preference', 'other') AS format_hint FROM (SELECT *, {_TYPE} AS kind FROM said)"))
def channel_rules(s, d):
    return typed(s, d).select("conv_id", "turn", *[c.alias(n) for n, c in routing.channels(F.col("kind")).items()])


@query("g28_dispatch", S(f"SELECT conv_id AS question_id, specialist, answer FROM (SELECT conv_id, ['cr', 'tr', 'msr', 'ie_ku', 'none'][(turn % 5 + 1)::INT] AS specialist, turn % 5 AS place, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'I could not say: the context does not contain it.' ELSE left(text, 40) END AS answer FROM said) WHERE place < 4 AND trim(answer) <> '' AND NOT {has('answer', *routing.REFUSALS)} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place, answer) = 1"))
def dispatch(s, d):
    """A conversation's turns as what each specialist answers to one question; a third of them refuse."""
    who = F.element_at(F.array(*map(F.lit, [*routing.SPECIALISTS, "none"])), (F.col("turn") % 5 + 1).cast("int"))
    answer = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "I could not say: the context does not contain it.").otherwise(F.substring("text", 1, 40))
    return routing.dispatched(said(s, d).select(F.col("conv_id").alias("question_id"), who.alias("specialist"), answer.alias("answer")))


_SAID = S("", "").split("AS (", 1)[1].strip().removesuffix(")")


@query(
    "r25_reflections",
    with_views(
        f", said AS ({_SAID}), q AS (SELECT conv_id, turn, conv_id % 20 AS user_id, v.embedding::DOUBLE[] AS vector FROM said JOIN embeddings v ON v.vec_id = conv_id WHERE {_TYPE} <> 'other')"
        " SELECT conv_id, turn, m.id, round(list_cosine_similarity(vector, m.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN memories m USING (user_id) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY list_cosine_similarity(vector, m.embedding::DOUBLE[]) DESC, m.id) <= 3",
        "memories",
    ),
)
def reflections(s, d):
    """Turns as questions of a user, with the vector that is stored under their conversation's id."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    asked = typed(s, d).join(v, "conv_id").select(F.struct("conv_id", "turn").alias("question_id"), (F.col("conv_id") % 20).alias("user_id"), "kind", "vector")
    out = routing.reflections(asked, mem(s, d).select("id", "user_id", "embedding"))
    return out.select("question_id.conv_id", "question_id.turn", "id", F.round("similarity", 6).alias("similarity"))


def _chunk_sql(split: str, most: int, step: int, join: str) -> str:
    parts = rf"list_filter(list_transform({split}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    runs = f"list_transform(range(0, ceil((len(p) - {most}) / {step}.0)::BIGINT + 1), lambda k: {join.format(run=f'array_to_string(p[k * {step} + 1:k * {step} + {most}], SEP)')})"
    return f"SELECT doc_id, unnest(CASE WHEN len(p) <= {most} THEN [text] ELSE {runs} END) AS chunk FROM (SELECT doc_id, text, {parts} AS p FROM documents WHERE coalesce(text, '') <> '')"


@query("f14_sentence_chunks", _chunk_sql(r"regexp_split_to_array(text, '[.!?]+')", 5, 4, "{run} || '.'").replace("SEP", "'. '"))
def sentence_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(chunking.by_sentences(F.col("text"), 5)).alias("chunk"))


@query("f14b_paragraph_chunks", _chunk_sql(r"regexp_split_to_array(text, '\n\s*\n')", 2, 2, "{run}").replace("SEP", "chr(10) || chr(10)"))
def paragraph_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(chunking.by_paragraphs(F.col("text"), 2)).alias("chunk"))


@query("f14c_separator_chunks")
def separator_chunks(s, d):
    c = chunking.by_separator(table(s, d, "documents"), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "start", "end", "words", F.sha2("content", 256).alias("content_sha256"))


# Derived texts -----------------------------------------------------------------------------------

_LINE = r"regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '^ ', '')"
_SHORT = f"CASE WHEN length({_LINE}) <= 120 THEN {_LINE} ELSE left({_LINE}, 117) || '...' END"


def _digest_sql(name: str, rows: str, group: str, k: int, least: int = 1) -> str:
    return (
        f", {name}_d AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY coalesce(importance, 0) DESC, id) AS place, count(*) OVER (PARTITION BY {group}) AS members FROM ({rows}) WHERE trim(coalesce(content, '')) <> ''),"
        f" {name} AS (SELECT {group}, max(members) AS members, string_agg({_SHORT}, chr(10) ORDER BY place) FILTER (WHERE place <= {k}) AS text FROM {name}_d WHERE members >= {least} GROUP BY {group})"
    )


@query("g24_user_profiles", with_views(_digest_sql("p", "SELECT * FROM memories WHERE memory_type IS NOT NULL", "user_id, memory_type", 3) + " SELECT user_id, sum(members)::BIGINT AS members, string_agg('## ' || memory_type || ' (' || members || ')' || chr(10) || text, chr(10) ORDER BY memory_type) AS text FROM p GROUP BY user_id", "memories"))
def user_profiles(s, d):
    return summaries.profiles(mem(s, d), "user_id", "memory_type")


@query("g24b_recaps", with_views(_digest_sql("p", "SELECT * FROM memories", "topic", 4, 3) + " SELECT topic, members, text, row_number() OVER (ORDER BY members DESC, topic) AS place FROM p QUALIFY place <= 8", "memories"))
def recaps(s, d):
    return summaries.recaps(mem(s, d), ["topic"], 3, 4, 8).select("topic", "members", "text", F.col("place").cast("long").alias("place"))


@query(
    "g24c_entity_cards",
    with_views(
        _digest_sql("o", "SELECT * FROM memories WHERE id % 9 > 0", "user_id, namespace", 2) + _digest_sql("n", "SELECT * FROM memories", "user_id, namespace", 2)
        + " SELECT n.user_id, n.namespace, n.members, n.text, CASE WHEN o.text IS NULL THEN 1 WHEN o.text = n.text THEN 4 ELSE 5 END AS version, o.text IS NULL OR o.text <> n.text AS changed FROM n LEFT JOIN o ON n.user_id = o.user_id AND n.namespace = o.namespace",
        "memories",
    ),
)
def entity_cards(s, d):
    """Cards at version 4 of all memories but every ninth, then of all."""
    group = ["user_id", "namespace"]
    before = summaries.digests(mem(s, d).where("id % 9 > 0"), group, 2).select(*group, "text", F.lit(4).alias("version"))
    return summaries.cards(mem(s, d), group, before, 2)


# Rescue ------------------------------------------------------------------------------------------

_STEMS = "list_distinct(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')))"
_ALL = "list_transform(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), lambda w: regexp_replace(w, '(ing|ed|es|s)$', ''))"
_RESCUE_SQL = with_views(
    f", said AS ({_SAID}), q AS (SELECT conv_id, turn, conv_id % 20 AS user_id, (conv_id + turn) % 3 = 0 AS failed, {_STEMS.format(c='text')} AS terms FROM said WHERE role = 'user'),"
    " t AS (SELECT conv_id, turn, user_id, len(terms) AS asked, unnest(terms) AS term FROM q WHERE failed),"
    f" p AS (SELECT id, user_id, len(w) AS length, unnest(w) AS term FROM (SELECT id, user_id, {_ALL} AS w FROM memories)), tf AS (SELECT id, user_id, length, term, count(*) AS tf FROM p GROUP BY ALL),"
    " again AS (SELECT conv_id, turn, tf.id, count(*)::DOUBLE / any_value(asked) AS score, sum(tf)::DOUBLE / any_value(length) AS often FROM t JOIN tf ON t.user_id = tf.user_id AND t.term = tf.term GROUP BY conv_id, turn, tf.id QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, often DESC, tf.id) <= 4),"
    " first AS (SELECT conv_id, turn, m.id, 0.5::DOUBLE * m.importance AS score FROM q JOIN (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) <= 3) m USING (user_id)),"
    " u AS (SELECT conv_id, turn, id, max(score) AS score FROM (SELECT conv_id, turn, id, score FROM first UNION ALL SELECT conv_id, turn, id, score FROM again) GROUP BY conv_id, turn, id)"
    " SELECT conv_id, turn, id, round(score, 6) AS score, (conv_id + turn) % 3 = 0 AS rescued FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY u.score DESC, id) <= 5",
    "memories",
)


@query("r27_rescue", _RESCUE_SQL)
def rescue(s, d):
    """User turns as questions; those that are refused an answer are asked again by their words, through the index."""
    q = said(s, d).where("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), (F.col("conv_id") % 20).alias("user_id"), textindex.terms(F.col("text")).alias("terms"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "The context does not contain it.").otherwise("yes").alias("answer"))
    best = top_k(mem(s, d).select("user_id", "id", F.col("importance").cast("double").alias("importance")), 3, F.desc("importance"), F.asc("id"), by=("user_id",))
    first = q.join(best, "user_id").select("question_id", "id", (0.5 * F.col("importance")).alias("score"))
    index = memory_index(s, d)
    again = textindex.search(q.where(routing.refused(F.col("answer"))), index, 4, scope="user_id")
    out = routing.rescued(q.select("question_id", "answer"), first, again, 5)
    return out.select("question_id.conv_id", "question_id.turn", "id", F.round("score", 6).alias("score"), "rescued")


# Wiki pages --------------------------------------------------------------------------------------

_PAGES = (
    "SELECT CASE WHEN page_id % 7 = 0 THEN 'drafts' WHEN page_id % 2 = 0 THEN 'concepts' ELSE 'queries' END AS directory, CASE WHEN page_id % 11 = 3 THEN 'page-' || page_id // 11 % 3 ELSE 'page-' || page_id END AS slug, url AS path, 'Page ' || page_id AS title, NULL::VARCHAR AS summary, ['p' || page_id % 3] AS tags, html AS body FROM pages"
)
_WIKI_SQL = (
    f"WITH p AS ({_PAGES}), n AS (SELECT *, count(*) OVER (PARTITION BY directory, slug) AS n FROM p) SELECT 'wiki/notes/' || directory || '/' || slug AS external_id, 'verbatim' AS mode, sha256(coalesce(body, '')) AS content_sha256,"
    " '{\"externalId\":\"wiki/notes/' || directory || '/' || slug || '\",\"wiki\":{\"version\":1,\"trustLevel\":\"external-import\",\"projectId\":\"notes\",\"path\":' || to_json(path) || ',\"pageDirectory\":\"' || directory || '\",\"slug\":\"' || slug || '\",\"title\":\"' || title || '\",\"summary\":null,\"tags\":[\"' || tags[1] || '\"]}}' AS metadata"
    " FROM n WHERE n = 1 AND directory <> 'drafts'"
)


@query("a14_ingest_inputs", _WIKI_SQL)
def ingest_inputs(s, d):
    """Pages as those of a wiki; some are in a folder that isn't allowed, some share a slug."""
    i = F.col("page_id")
    directory = F.when(i % 7 == 0, "drafts").when(i % 2 == 0, "concepts").otherwise("queries")
    slug = F.concat(F.lit("page-"), F.when(i % 11 == 3, F.expr("page_id div 11 % 3")).otherwise(i).cast("string"))
    pages = table(s, d, "pages").select(
        directory.alias("directory"), slug.alias("slug"), F.col("url").alias("path"), F.concat(F.lit("Page "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.array(F.concat(F.lit("p"), (i % 3).cast("string"))).alias("tags"), F.col("html").alias("body"),
    )
    inputs, _ = wiki.ingest_inputs(pages, "notes", "u")
    return inputs.select("external_id", "mode", F.sha2("content", 256).alias("content_sha256"), "metadata")
