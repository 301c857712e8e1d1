"""Text expressions: sanitising, classification, keywords, dates, chunking."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
STOP = ("the", "and", "for", "with", "that", "this", "from", "was", "are", "have", "has", "not", "but", "you", "your", "they", "what", "when", "where", "who", "how")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(form: str, text: Column) -> Column:
    """Unicode normal form, which Spark has no function for."""

    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(normal, T.StringType())(text)


def entity_name(name: Column) -> Column:
    """Normal form of a name: decomposed, without combining marks, lower case, letters, digits, + and #."""
    plain = F.lower(F.regexp_replace(normalised("NFKD", name), r"\p{M}", ""))
    out = F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9+#]", " "), " +", " "))
    return F.when(out == "", F.lower(F.trim(name))).otherwise(out)


def detection_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalised("NFKC", text), "[​-‍⁠﻿]", ""), r"\s+", " "))


def anomalies(text: Column) -> Column:
    """Too long, too little ASCII, or one word over and over."""
    n = F.length(text)
    other = n - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # A word that is more than half of all is what pairwise cancelling leaves; counting it takes one more pass.
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"))
    step = lambda a, w: F.when(a["n"] == 0, F.struct(w.alias("w"), F.lit(1).alias("n"))).otherwise(F.struct(a["w"].alias("w"), F.when(a["w"] == w, a["n"] + 1).otherwise(a["n"] - 1).alias("n")))
    # Both are bound to lambda variables: as plain expressions they would be evaluated anew for every word.
    count = lambda ws: _let(F.aggregate(ws, start, step)["w"], lambda top: F.struct(F.size(ws).alias("all"), F.size(F.filter(ws, lambda w: w == top)).alias("most")))
    repeated = _let(_let(words, count), lambda c: (c["all"] >= 10) & (c["most"] >= 5) & (c["most"] / c["all"] > 0.5))
    flags = [(n > 2000, "length"), (other / F.greatest(n, F.lit(1)) > 0.3, "non_ascii"), (repeated, "repetition")]
    return F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in flags]), lambda x: x.isNotNull())


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def overview(text: Column) -> Column:
    """All sentences if three or fewer; else the first three, or two of a long text."""
    s = sentences(text)
    return F.array_join(F.when(F.size(s) <= 3, s).when(F.length(text) > 300, F.slice(s, 1, 2)).otherwise(F.slice(s, 1, 3)), " ")


def headline(text: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 10), " ")


def keywords(text: Column, least: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP)))


def entity_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    compound = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+[-_.][a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(F.array_except(words, F.array(*map(F.lit, STOP))), compound)))


def duration(days: Column, unit: str) -> Column:
    return F.floor(days / {"days": 1, "weeks": 7, "months": 30}[unit] + 0.5).cast("long")


def abstains(answer: Column) -> Column:
    return F.lower(answer).rlike("(don't know|do not know|no information|not mentioned|cannot answer)")


def signals(text: Column) -> Column:
    """Conflict signals: negation, replacement, uncertainty, safety."""
    t = F.lower(text)
    flags = [(r"\b(not|never|no longer|n't)\b", "negation"), (r"\b(instead|switched|replaced|changed)\b", "replacement"), (r"\b(maybe|might|perhaps|unsure)\b", "uncertainty"), (r"\b(allergic|allergy|medication|emergency)\b", "safety")]
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for p, n in flags]), lambda x: x.isNotNull())


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_error(text: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r"(?i)(key|token|secret)=\S+", "$1=***"), 1, most)


def source_kind(site: Column, known: list[str]) -> Column:
    return F.when(site.rlike("^(doc|file|drive):"), "document").when(site.isin(*known), "conversation").otherwise("other")


def infer_namespace(site: Column, topic: Column) -> Column:
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat_ws("/", slug(site), F.when(topic.isNotNull(), slug(topic)))


def first_object(raw: str | None) -> str | None:
    """The first JSON object in a text, without code fences; one that breaks off is closed; the text itself if it has none."""
    if raw is None:
        return None
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    start = text.find("{")
    if start < 0:
        return text
    closers, quoted, skip = [], False, False
    for k in range(start, len(text)):
        c = text[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]" and closers:
            closers.pop()
            if not closers:
                return text[start : k + 1]
    return text[start:] + '"' * quoted + "".join(reversed(closers))


def json_object(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(first_object), T.StringType())(text)


def cursor(*columns: str) -> Column:
    """A keyset cursor as base64 of JSON."""
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


def cut(text: str, size: int = 1500, overlap: int = 150, least: int = 100) -> list[tuple[int, int]]:
    """Chunk offsets: windows of up to ``size`` characters, ended at white space if there is some behind the first
    ``least``, trimmed; the next starts ``overlap`` before the end.  A window shorter than ``least`` is no chunk."""
    size = max(1, size)
    overlap, least = min(max(0, overlap), size // 2), max(1, min(least, size))
    out, pos, n = [], 0, len(text)
    while pos < n:
        end = min(n, pos + size)
        if end < n:
            end = next((k for k in range(end, pos + least, -1) if text[k - 1].isspace()), end)
        a, b = pos, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b - a >= least:
            out.append((a, b))
        if end >= n:
            break
        pos = end - overlap if end - overlap > pos else end
    return out


#: Characters of output text in one batch that a task makes from texts.
MADE = 1 << 20
#: What a row counts for besides its texts.
ROW = 64


def made(batches: Iterator[pa.RecordBatch], rows: Callable[[str], Iterable[tuple]], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, *columns): what ``rows`` makes of each text of batches (id, text), of little more than MADE characters."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        at: list[int] = []
        out: list[list] = [[] for _ in columns]
        held = 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(x, t) for x, t in zip(out, columns.values(), strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *arrays], names=["id", *columns])  # noqa: B023

        for i in range(len(texts)):
            for row in rows(texts[i].as_py() or ""):  # null and empty texts have no rows
                at.append(i)
                for x, v in zip(out, row, strict=True):
                    x.append(v)
                held += ROW + sum(len(v) for v in row if isinstance(v, str))
                if held >= MADE:
                    yield batch()
                    at, out, held = [], [[] for _ in columns], 0
        if at:
            yield batch()


def by_text(docs: DataFrame, id_col: str, text_col: str, rows: Callable[[str], Iterable[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """(id, *columns): the rows made of each document's text, in the documents' own partitions; texts are read one at a time."""
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join([f"id {source.schema['id'].dataType.simpleString()}", *[f"{c} {names[t]}" for c, t in columns.items()]])
    return source.mapInArrow(lambda batches: made(batches, rows, columns), schema)


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 150, least: int = 100) -> DataFrame:
    """(id, chunk_index, char_start, char_end, content, content_hash, token_count)"""
    columns = {"chunk_index": pa.int32(), "char_start": pa.int32(), "char_end": pa.int32(), "content": pa.string(), "content_hash": pa.string(), "token_count": pa.int64()}

    def rows(t: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(cut(t, size, overlap, least)):
            c = t[a:b]
            yield k, a, b, c, hashlib.sha256(c.encode()).hexdigest(), max(1, -(-(b - a) // 4))

    return by_text(docs, id_col, text_col, rows, columns)


def turn_windows(turns: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """(conv_id, win, content): overlapping windows of turns of a conversation."""
    step = size - overlap
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    g = turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.size("lines") - overlap) / step).cast("int") - 1)
    g = g.select("conv_id", "lines", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    return g.select("conv_id", "win", F.array_join(F.slice("lines", F.col("win") * step + 1, F.lit(size)), "\n").alias("content"))


#: Code point of the first bucket's letter; letters go up to U+00FF.
FIRST_LETTER = 48


def embed(texts: Column, dim: int = 64) -> Column:
    """The default embedder: a bag of hashed words at unit length.  A model takes its place as another pandas UDF."""
    if dim > 256 - FIRST_LETTER:
        raise ValueError(f"at most {256 - FIRST_LETTER} dimensions")
    words = F.regexp_extract_all(F.lower(texts), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    # A word's bucket as a letter, so that a bucket's count is what the letters lose without it; each step is bound once.
    letters = F.array_join(F.transform(words, lambda w: F.char(F.pmod(F.xxhash64(w), F.lit(dim)) + FIRST_LETTER)), "")
    count = lambda s, i: (F.length(s) - F.length(F.replace(s, F.lit(chr(FIRST_LETTER + i)), F.lit("")))).cast("double")
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    vector = bound(letters, lambda s: F.array(*[count(s, i) for i in range(dim)]))
    unit = lambda v: bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return bound(vector, unit)
