"""Packing of documents into windows of fixed length by sum of squares, online (operator 12).

A document is its token ids and an end id.  Of a document longer than a window every full length is a
window of its own; the rest, shorter than a window, is one item.  Items are placed as they come: a level
array counts the open windows at each fill level, and an item goes into the level (or opens a window)
for which the sum of the squared counts becomes least.  A window that fills up is closed.

What is still open when a task's documents end, or when ``MOST_OPEN`` windows are open at once, is
closed without padding: windows filled to a power of two are complete as they are; the items of the
others are laid end to end in the order of their windows and cut at full windows, and the last, shorter
than a window, is cut at the powers of two that make it up.  So only items of those windows are cut.

Scale: one pass over the texts and no shuffle.  A task packs the documents of its input partition, which
Spark sizes; it keeps the level array, the ids of at most ``MOST_OPEN`` open windows (32 MB), the ids of
``MOST_PARTS`` words and one batch of documents.  A place costs one vector operation over the levels, whatever the number of
documents or open windows.  Sequence ids count within a task from a start of their own, as Spark's
increasing ids do, so they need no counting job; a task that is run again repeats its ids and pieces.

Defined results: a null or empty text is the end id alone; texts of any length are encoded whole;
levels that tie lose to the fullest, windows of a level to the one filled last; repeated rows are packed each; an empty table gives no
rows; further columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.llm.common import documents

WINDOW = 2048
END = 1
MOST_OPEN = 4096
#: Documents in a batch of pieces.
BATCH = 64
#: Encoded parts a worker keeps, and the bytes of the longest.
MOST_PARTS, LONG_PART = 1 << 19, 64
#: First sequence id of a task is its number times this.
SEQUENCES = 1 << 33

PIECE = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows of one task, by fill level.

    add() and close() return closed windows: lists of (tag, start, ids) in order of their offsets.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        # count[window] stays 0: a window filled to its end is closed.
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]
        self.opened = 0

    def level_for(self, size: int) -> int:
        """The level whose window takes an item of this size; 0 is a new window."""
        levels = np.flatnonzero(self.count[: self.window - size + 1])
        if not len(levels):
            return 0
        to = levels + size
        # Change of the sum of squares, less a common 1: a count falls by one, another grows unless the window closes.
        change = np.where(to == self.window, -2 * self.count[levels], 2 * (self.count[to] - self.count[levels]) + 1)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * self.count[size] else 0

    def add(self, tag, start: int, ids: np.ndarray) -> list[list]:
        """Place an item shorter than a window."""
        size = len(ids)
        level = self.level_for(size)
        if level:
            self.count[level] -= 1
            number, items = self.open[level].pop()
        else:
            number, items = self.opened, []
            self.opened += 1
        items.append((tag, start, ids))
        if level + size == self.window:
            return [items]
        self.count[level + size] += 1
        self.open[level + size].append((number, items))
        return self.close() if self.count.sum() >= self.most_open else []

    def close(self) -> list[list]:
        """Close all windows: those at a power of two as they are, the others refilled, the rest cut at powers of two."""
        whole, loose = [], []
        for level, windows in enumerate(self.open):
            (whole if level & (level - 1) == 0 else loose).extend(windows)
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        out = [items for _, items in sorted(whole, key=lambda w: w[0])]
        items = [x for _, w in sorted(loose, key=lambda w: w[0]) for x in w]
        left = sum(len(ids) for _, _, ids in items)
        room, now = 0, []
        for tag, start, ids in items:
            while len(ids):
                if not room:
                    now = []
                    out.append(now)
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                now.append((tag, start, ids[:room]))
                took = min(room, len(ids))
                start, ids, room = start + took, ids[took:], room - took
        return out


#: Printable characters up to U+00FF, without a mark of special tokens: composed already, lower case is by character.
_PLAIN = re.compile(r"(?!.*<\|)[!-~\xa1-\xff]+")
#: Letters and numbers among them, once in lower case.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level merges: itself if printable, else one from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder(dict):
    """Ids of texts, without the end id, as a tokenizer file gives them.

    The tokenizer drops white space and looks at nothing across it, so a text's ids are those of the
    parts between ASCII white space, one after the other.  The dictionary holds the ids of parts met,
    up to ``MOST_PARTS`` of them.  A part of plain characters needs no normalisation but lower case, so
    it is split by the file's own pattern and its words go straight to the merges; other parts, or all
    if the file is of another make, take the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kinds = lambda key, inner: [x["type"] for x in (made[key] or {}).get(inner, [])]
        simple = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        self.split = re.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS)).findall if simple else None
        self.table = byte_letters()

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("utf-8")
        if self.split and _PLAIN.fullmatch(text):
            words, out = self.words, []
            for w in self.split(text.lower()):
                if (ids := words.get(w)) is None:
                    seen = w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.table)
                    ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(seen)])
                    if len(words) < MOST_PARTS and len(w) <= LONG_PART:
                        words[w] = ids
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= LONG_PART:
            self[part] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self) > MOST_PARTS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode("utf-8").split())), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each file in a worker, so that tasks which follow each other share what it has learnt."""
    return Encoder(path)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, most_open: int = MOST_OPEN,
) -> DataFrame:
    """One row for each piece of a document: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a file that every executor has.  start and offset count ids before the
    piece in its document and in its sequence; ids are little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = PIECE.format(id=rows.schema["id"].dataType.simpleString())
    types = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), SumOfSquares(window, most_open)
        sequence = TaskContext.get().partitionId() * SEQUENCES

        def rows_of(closed: list[list]) -> Iterator[tuple]:
            nonlocal sequence
            for items in closed:
                offset = 0
                for (i, total), start, ids in items:
                    yield i, start, len(ids), ids.tobytes(), total, sequence, offset
                    offset += len(ids)
                sequence += 1

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces, strict=True), types, strict=True)], schema=types)

        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                names, texts = (c.slice(a, BATCH).to_pylist() for c in b.columns)
                pieces: list[tuple] = []
                for i, text in zip(names, texts, strict=True):
                    ids = np.append(encode(text), np.array(end, "<u4"))
                    whole = len(ids) - len(ids) % window
                    closed = [[((i, len(ids)), k, ids[k : k + window])] for k in range(0, whole, window)]
                    if whole < len(ids):
                        # A copy, so that an open window doesn't hold the rest of a long document.
                        closed += packer.add((i, len(ids)), whole, ids[whole:].copy())
                    pieces += rows_of(closed)
                if pieces:
                    yield batch(pieces)
        if pieces := list(rows_of(packer.close())):
            yield batch(pieces)

    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids, parts): the sequences themselves, with the (id, start, length, offset) of their pieces.

    A group is one window at most.
    """
    part = F.struct("offset", "id", "start", "length", "ids")
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return made.select("sequence_id", "tokens", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(tokens, padding, sequences, documents, cut): what a packing costs; cut counts documents in more pieces than their length needs."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    bits = F.bit_count("n")
    total = per.agg(F.sum("n").alias("tokens"), F.sum(F.when(bits == 1, 0).otherwise(window - F.col("n"))).alias("padding"), F.count(F.lit(1)).alias("sequences"))
    docs = pieces.groupBy("id", "doc_tokens").agg(F.count(F.lit(1)).alias("k"))
    cut = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("k") > F.ceil(F.col("doc_tokens") / window)).cast("long")).alias("cut"))
    return total.join(cut)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
