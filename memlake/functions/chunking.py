"""Chunks by a separator, by sentences and by paragraphs: the client's rules, beside the server's in ``text``.

Defined results: null and empty texts have no chunks; a text of few enough sentences or paragraphs is one
chunk, as it is; an overlap of a whole chunk or more leaves one chunk; texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import by_text


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(parts: Column, text: Column, most: int, overlap: int, join) -> Column:
    """Runs of ``most`` parts, each starting ``overlap`` before the end of the one before, until the parts end."""
    step = most - overlap

    def cut(p: Column) -> Column:
        n = F.size(p)
        last = F.ceil((n - most) / step).cast("int") if step > 0 else F.lit(0)
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: join(F.slice(p, k * max(step, 0) + 1, F.lit(most))))
        return F.when(n <= most, F.array(text)).otherwise(runs)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(_let(parts, cut))


def _parts(text: Column, pattern: str) -> Column:
    cut = F.transform(F.split(text, pattern, -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda x: x != "")


def by_sentences(text: Column, most: int, overlap: int = 1) -> Column:
    """Chunks of sentences, their ends written as full stops."""
    return _windows(_parts(text, "[.!?]+"), text, most, overlap, lambda p: F.concat(F.array_join(p, ". "), F.lit(".")))


def by_paragraphs(text: Column, most: int, overlap: int = 0) -> Column:
    """Chunks of paragraphs, which blank lines part."""
    return _windows(_parts(text, r"\n\s*\n"), text, most, overlap, lambda p: F.array_join(p, "\n\n"))


def cut(text: str, size: int, overlap: int, separator: str = " ", least: int | None = None) -> list[tuple[int, int]]:
    """Chunk offsets before trimming: windows of ``size``, ended at their last separator if that is behind the first
    ``least`` characters (a tenth unless given); the next starts ``overlap`` before the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size must be positive, the overlap smaller")
    if len(text) <= size:
        return [(0, len(text))] if text else []
    least = max(1, min(size // 10 if least is None else least, size))
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (at := text.rfind(separator, start, end)) > start + least:
            end = at
        if len(text[start:end].strip()) >= least:
            out.append((start, end))
        if end >= len(text):
            break
        start = end - overlap if end - overlap > start else end
    return out


def by_separator(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100, separator: str = " ", least: int | None = None) -> DataFrame:
    """(id, chunk_index, start, end, content, words): a document's chunks, in the documents' own partitions."""
    columns = {"chunk_index": pa.int32(), "start": pa.int32(), "end": pa.int32(), "content": pa.string(), "words": pa.int32()}

    def rows(t: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(cut(t, size, overlap, separator, least)):
            c = t[a:b]
            yield k, a, b, c.strip(), len(c.split())

    return by_text(docs, id_col, text_col, rows, columns)
