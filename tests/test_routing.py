"""Question routing and the client's chunks on small inputs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.functions import chunking, text
from memlake.operators import routing


def test_channels(spark):
    kinds = ["ordered_list", "contradiction", "summary", "preference", "other", "exact_date", None]
    rows = spark.createDataFrame([(k,) for k in kinds], "kind string").select("kind", *[c.alias(n) for n, c in routing.channels(F.col("kind")).items()]).collect()
    assert {r["kind"] for r in rows if r["event_chain"]} == {"ordered_list"}
    assert {r["kind"] for r in rows if r["observations"]} == {"contradiction", "summary"}
    assert {r["kind"] for r in rows if r["format_hint"]} == {"ordered_list", "contradiction", "summary", "exact_date"}


def test_the_first_answer_that_is_none_of_refusal_stands(spark):
    rows = [(1, "msr", "3 races"), (1, "tr", "5 days"), (1, "cr", "I cannot find the notes"), (2, "cr", ""), (2, "tr", None), (2, "ie_ku", "insufficient context"), (3, "ie_ku", "blue"), (3, "other", "red"), (4, "cr", "both"), (4, "tr", "x")]
    got = routing.dispatched(spark.createDataFrame(rows, "question_id int, specialist string, answer string")).collect()
    assert {r["question_id"]: (r["specialist"], r["answer"]) for r in got} == {1: ("tr", "5 days"), 3: ("ie_ku", "blue"), 4: ("cr", "both")}


def test_reflections_of_routed_types_only(spark):
    q = spark.createDataFrame([(1, "u", "summary", [1.0, 0.0]), (2, "u", "other", [1.0, 0.0]), (3, "v", "exact_date", [0.0, 1.0])], "question_id int, user_id string, kind string, vector array<double>")
    s = spark.createDataFrame([(k, "u", [1.0, k / 10]) for k in range(5)] + [(9, "w", [1.0, 0.0])], "id int, user_id string, embedding array<double>")
    assert sorted((r["question_id"], r["id"]) for r in routing.reflections(q, s).collect()) == [(1, 0), (1, 1), (1, 2)]


def test_sentence_and_paragraph_chunks(spark):
    texts = {"a": "One. Two! Three? Four. Five", "b": "One. Two.", "c": "", "d": None, "e": "p1\n\np2\n \np3\n\n\n", "f": "...", "g": "1. 2. 3."}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {r["id"]: (r["s"], r["p"], r["w"]) for r in df.select("id", chunking.by_sentences(F.col("text"), 3).alias("s"), chunking.by_paragraphs(F.col("text"), 2).alias("p"), chunking.by_sentences(F.col("text"), 2, 2).alias("w")).collect()}
    assert got["a"] == (["One. Two. Three.", "Three. Four. Five."], [texts["a"]], ["One. Two."])
    assert got["b"][0] == [texts["b"]] and got["c"] == got["d"] == ([], [], [])
    assert got["e"][1] == ["p1\n\np2", "p3"] and got["f"][0] == ["..."] and got["g"][0] == ["1. 2. 3."]


def plain(text, size, overlap, least):
    """Windows one character at a time."""
    out, start = [], 0
    if len(text) <= size:
        return [text.strip()] if text else []
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            spaces = [k for k in range(start, end) if text[k] == " "]
            if spaces and spaces[-1] - start > least:
                end = spaces[-1]
        if len(text[start:end].strip()) >= least:
            out.append(text[start:end].strip())
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def test_separator_chunks(spark):
    r = random.Random(1)
    texts = [None, "", " ", "x" * 95, *["".join(r.choice("ab  \n") for _ in range(r.randrange(200))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((20, 5), (10, 9), (30, 0)):
        got = {}
        for c in chunking.by_separator(df, "id", "text", size, overlap).orderBy("id", "chunk_index").collect():
            got.setdefault(c["id"], []).append(c["content"])
            assert c["words"] == len(c["content"].split())
        assert got == {i: want for i, t in enumerate(texts) if (want := plain(t or "", size, overlap, max(1, size // 10)))}
    with pytest.raises(ValueError):
        chunking.cut("abc", 5, 5)


def test_refused_questions_are_asked_again(spark):
    answers = spark.createDataFrame([(1, "blue"), (2, "no information"), (3, None)], "question_id int, answer string")
    first = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.5), (2, 11, 0.1)], "question_id int, id int, score double")
    again = spark.createDataFrame([(1, 99, 1.0), (2, 11, 0.9), (2, 12, 0.4), (3, 10, 0.2)], "question_id int, id int, score double")
    got = [tuple(r) for r in routing.rescued(answers, first, again, 2).collect()]
    assert sorted(got) == [(1, 10, 0.5, False), (2, 10, 0.5, True), (2, 11, 0.9, True), (3, 10, 0.2, True)]


def test_wiki_pages_become_inputs(spark):
    from memlake.sources import wiki

    rows = [("concepts", "a-b", "x"), ("queries", "a-b", None), ("concepts", "twice", "1"), ("concepts", "twice", "2"), ("other", "c", "x"), ("concepts", "../c", "x"), (None, "d", "x"), ("concepts", None, "x")]
    pages = spark.createDataFrame([(d, s, f"{d}/{s}", "T", None, ["t"], b) for d, s, b in rows], "directory string, slug string, path string, title string, summary string, tags array<string>, body string")
    good, bad = wiki.ingest_inputs(pages, "notes", "u")
    assert {(r["external_id"], r["content"]) for r in good.collect()} == {("wiki/notes/concepts/a-b", "x"), ("wiki/notes/queries/a-b", "")}
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate"] * 2 + ["not allowed"] * 4
    assert wiki.ingest_inputs(pages, "Not Allowed", "u")[0].collect() == []


def test_chunks_leave_in_small_batches():
    """However many texts a batch has, what is made of them goes on after MADE characters; the whole is that of one batch."""
    docs = [None, "", "a b " * 400_000, *["word " * 700] * 3000]
    b = pa.RecordBatch.from_pydict({"id": range(len(docs)), "text": docs})
    rows = lambda t: ((k, t[x:y]) for k, (x, y) in enumerate(chunking.cut(t, 1000, 100)))
    out = list(text.made(iter([b]), rows, {"k": pa.int32(), "content": pa.string()}))
    assert len(out) > 10 and max(x.nbytes for x in out) < 2 * text.MADE
    got = [(i, k, c) for x in out for i, k, c in zip(*(y.to_pylist() for y in x.columns), strict=True)]
    assert got == [(i, k, c) for i, t in enumerate(docs) for k, c in rows(t or "")]
