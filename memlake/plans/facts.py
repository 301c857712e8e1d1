"""Queries over facts that split, their entities and relations, event anchors, quoted titles and temporal evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import conflict
from memlake.operators import evidence as E
from memlake.operators import facts as O
from memlake.plans.rules import S, lit, said
from memlake.registry import query
from memlake.sources.tables import table

KEYS = ["conv_id", "turn"]


def rule_facts(s, d):
    """(conv_id, turn, fact, type, importance, keywords) of every user turn."""
    f = conflict.rule_facts(said(s, d).where("role = 'user'"), KEYS, "text")
    return f.select(*KEYS, "fact", "type", F.col("importance").cast("double").alias("importance"), "keywords")


def dated(s, d):
    """The same, as they would be stored: each under the day its conversation was recorded."""
    day = F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), (F.col("conv_id") % 400).cast("int")), "MMMM d yyyy")
    return rule_facts(s, d).withColumn("fact", F.concat(F.lit("As of "), day, F.lit(", user said: "), F.col("fact")))


def _flat(df, *columns):
    return df.select(*columns, "position", "fact", "type", F.round("importance", 6).alias("importance"), F.array_join("keywords", ",").alias("keywords"))


@query("f26_split_facts")
def split_facts(s, d):
    return _flat(O.normalise(rule_facts(s, d)), *KEYS)


def bare_facts(s, d):
    """The same without keywords, which the rules then derive."""
    return rule_facts(s, d).withColumn("keywords", F.lit(None).cast("array<string>"))


@query("f24_fact_keywords")
def fact_keywords(s, d):
    return O.keywords(rule_facts(s, d), [*KEYS, "fact"])


@query("f27_relations")
def relations(s, d):
    return O.relations(bare_facts(s, d), [*KEYS, "fact"])


@query("f27b_entities")
def entities(s, d):
    return O.entities(bare_facts(s, d), [*KEYS, "fact"])


@query("f28_event_anchors")
def event_anchors(s, d):
    return _flat(O.event_anchors(dated(s, d)), *KEYS)


def titled(s, d):
    """Turns that name something: on even turns a book of the turn's first letters, on odd ones a concert of the conversation's."""
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    title = F.concat(F.lit("The "), F.trim(F.substring(F.regexp_replace(line, "[^A-Za-z ]+", ""), 1, 20)))
    band = F.concat(F.lit("Band X"), F.translate(F.col("conv_id").cast("string"), "0123456789", "abcdefghij"))
    said_ = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('I was reading "'), title, F.lit('" again.'))).otherwise(F.concat(F.lit("We were at a "), band, F.lit(" concert yesterday.")))
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.concat(said_, F.lit(" "), line).alias("text"))


_TITLE = r"'The ' || trim(substr(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[^A-Za-z ]+', '', 'g'), 1, 20))"
_QUOTED_SQL = f"""
SELECT conv_id, turn, 0 AS position, fact, 'knowledge' AS type, 0.7::DOUBLE AS importance, keywords FROM (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || ' read "' || trim(title) || '".' ELSE role || ' saw "' || band || '" perform music.' END AS fact,
         CASE WHEN turn % 2 = 0 THEN 'book,' || trim(title) ELSE 'artist,band,music,' || band END AS keywords
  FROM (SELECT conv_id, turn, role, {_TITLE} AS title, 'Band X' || translate(conv_id::VARCHAR, '0123456789', 'abcdefghij') AS band FROM conversations))"""


@query("f28b_quoted_facts", _QUOTED_SQL)
def quoted_facts(s, d):
    return _flat(O.quoted(titled(s, d), KEYS), *KEYS)


@query("f28c_supplemented_facts", f"SELECT conv_id, turn, count(*) AS n_facts FROM (SELECT conv_id, turn FROM ({_QUOTED_SQL}) UNION ALL SELECT conv_id, turn FROM conversations) GROUP BY conv_id, turn")
def supplemented_facts(s, d):
    """Whole turns as facts, and those of their titles beside them."""
    t = titled(s, d)
    whole = t.select(*KEYS, F.col("text").alias("fact"), F.lit("knowledge").alias("type"), F.lit(0.5).alias("importance"), F.array().cast("array<string>").alias("keywords"))
    more = O.quoted(t, KEYS).select(*KEYS, "fact", "type", "importance", "keywords")
    return O.supplemented(whole, more, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_facts"))


# Temporal evidence -------------------------------------------------------------------------------

GENERAL = "When did Anna visit the doctor in Paris before moving to Rome?"
POINT = "When did Anna meet the doctor recently?"
TWICE = "How many weeks passed between Anna's first and second doctor visit?"
_CREATED = "TIMESTAMP '2024-01-01' + INTERVAL (conv_id % 9 + turn * 5) DAY + INTERVAL (turn * 7 % 24) HOUR"


def memories(s, d):
    """Turns as dated memories of their conversation."""
    made = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(conv_id % 9 + turn * 5 AS INT), cast(turn * 7 % 24 AS INT))")
    return said(s, d).select("conv_id", F.col("turn").alias("id"), made.alias("created_at"), F.col("text").alias("content"))


def _scored_sql(question: str) -> str:
    anyof = lambda words: "(" + " OR ".join(f"contains(low, {lit(w)})" for w in words) + ")"
    total = lambda flags: " + ".join([f"({x})::INT" for x in flags] or ["0"])
    cases = " ".join(f"WHEN w = {lit(k)} THEN {lit(v)}" for k, v in E.IRREGULAR.items())
    cases += "".join(f" WHEN length(w) > {len(x) + 2} AND ends_with(w, '{x}') THEN left(w, length(w) - {len(x)})" for x in ("ing", "ed", "es", "s"))
    words = rf"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(low, '\b([a-z]+)''s\b', '\1', 'g'), '[^a-z0-9''\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 4), lambda w: CASE {cases} ELSE w END)"
    return (
        f", mem AS (SELECT conv_id, turn AS id, {_CREATED} AS created_at, text AS content, lower(text) AS low FROM said),"
        f" part AS (SELECT *, {words} AS words, {total(map(anyof, E.concepts(question)))} AS hits, {total(f'contains(low, {lit(x)})' for x in E.subjects(question))} AS names, {anyof(E.PLANNING)} AS plans FROM mem),"
        f" scored AS (SELECT *, {total(f'list_contains(words, {lit(E._stem(t))})' for t in E.terms(question))} + 2 * names + 2 * hits - CASE WHEN plans THEN 3 ELSE 0 END AS score FROM part),"
        " best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, hits DESC, names DESC, plans, created_at, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 3),"
        f" twice AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT * FROM scored WHERE hits >= {len(E.concepts(question))}"
        " QUALIFY row_number() OVER (PARTITION BY conv_id, created_at::DATE ORDER BY created_at, id) = 1) QUALIFY place <= 2),"
        " stable AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE NOT plans) OVER (PARTITION BY conv_id) AS done FROM best) WHERE done < 2 OR NOT plans),"
        " days AS (SELECT * FROM stable QUALIFY row_number() OVER (PARTITION BY conv_id, created_at::DATE ORDER BY rank) = 1),"
        " ends AS (SELECT * FROM (SELECT *, row_number() OVER w AS up, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC) AS down, count(*) OVER (PARTITION BY conv_id) AS n FROM days WINDOW w AS (PARTITION BY conv_id ORDER BY created_at)) WHERE n > 1 AND (up = 1 OR down = 1)),"
    )


def _shown_sql(lines: str) -> str:
    text = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
    about = lambda per, unit: f"'~' || floor(days / {per} + 0.5)::BIGINT || ' {unit}' || CASE WHEN floor(days / {per} + 0.5) <> 1 THEN 's' ELSE '' END || ' (' || days || ' days)'"
    words = f"CASE WHEN days < 7 THEN days || ' day' || CASE WHEN days <> 1 THEN 's' ELSE '' END WHEN days < 30 THEN {about('7.0', 'week')} WHEN days >= 30 THEN {about('30.0', 'month')} END"
    return f" line AS ({lines}) SELECT conv_id, place::INT AS place, label, id, created_at::DATE AS day, CASE WHEN length({text}) <= 160 THEN {text} ELSE left({text}, 157) || '...' END AS text, days, {words} AS elapsed FROM line"


def _pair_sql(table: str, place: str, last: str, first_label: str, last_label: str) -> str:
    days = "floor((epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY conv_id ORDER BY created_at))) / 86400000000.0 + 0.5)::BIGINT"
    return f"SELECT conv_id, {place} AS place, CASE WHEN {last} THEN '{last_label}' ELSE '{first_label}' END AS label, id, created_at, content, CASE WHEN {last} THEN {days} END AS days FROM {table}"


_PLAIN = "SELECT conv_id, rank AS place, 'matching event' AS label, id, created_at, content, NULL::BIGINT AS days FROM best"
_ENDS = _pair_sql("ends", "CASE WHEN up = 1 THEN 1 ELSE 2 END", "up > 1", "earliest matching event", "latest matching event")
_TWICE = _pair_sql("(SELECT * FROM twice WHERE n > 1)", "place", "place = 2", "first matching event", "second matching event")
_EITHER = f"SELECT * FROM ({_ENDS}) UNION ALL SELECT * FROM ({_PLAIN} WHERE conv_id NOT IN (SELECT conv_id FROM ends))"


@query("f33_matching_events", S(_shown_sql(_PLAIN), _scored_sql(POINT)))
def matching_events(s, d):
    return E.temporal_evidence(memories(s, d), "conv_id", POINT)


@query("f33b_duration_endpoints", S(_shown_sql(_EITHER), _scored_sql(GENERAL)))
def duration_endpoints(s, d):
    return E.temporal_evidence(memories(s, d), "conv_id", GENERAL)


@query("f33c_repeated_events", S(_shown_sql(f"SELECT * FROM ({_TWICE}) UNION ALL SELECT * FROM ({_EITHER}) WHERE conv_id NOT IN (SELECT conv_id FROM twice WHERE n > 1)"), _scored_sql(TWICE)))
def repeated_events(s, d):
    return E.temporal_evidence(memories(s, d), "conv_id", TWICE)
