"""SentencePiece BPE encoding and decoding by exact backtracking (operator 5).

A merge-type encoding is the one split of the text into vocabulary pieces in which every piece and
every adjacent pair of pieces is reproduced when its own text is merged anew.  So the encoder walks
left to right: an Aho-Corasick automaton gives the pieces that start at a position, longest first; a
piece is taken if it is compatible with the piece before it (checked by re-merging the two); if none
fits, the position is marked as failed in a bitfield and the last piece is exchanged for a shorter
one.  Every position fails once at most, so time is linear in the text.

Characters outside the vocabulary become byte pieces and never merge with their neighbours.  No piece
of the supported models has the space mark after another character, so a text is encoded run by
run - a run is space marks and what follows them - and a worker remembers the runs it has met.

Defined results: a null or empty text has no ids and decodes to the empty text; rows are independent,
so ties, repeated rows, empty tables and further columns need nothing special.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import documents

MARK = "▁"
#: Runs and pairs a worker remembers before it starts anew; a bound on memory, not on texts.
RUNS, PAIRS, RUN_CHARS = 250_000, 300_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = {i for i in range(n) if sp.is_unknown(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces across words")
        self.letters = {p for p in self.ids if len(p) == 1}
        if any(not self.letters.issuperset(p) for p in self.ids):
            raise ValueError("the model has pieces of characters that are no pieces")
        # The unescaped form of each piece, to decode by lookup; an ASCII byte stands for itself in any run of bytes.
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        for i in self.control:
            self.surface[i] = ""
        for i in self.unknown:
            self.surface[i] = " ⁇ "
        for b, i in self.byte_id.items():
            self.surface[i] = chr(b) if b < 128 else ""
        self.partial = np.zeros(n, bool)
        self.partial[[i for b, i in self.byte_id.items() if b >= 128]] = True
        self.numbers = [str(i) for i in range(n)]
        self.length = [len(p) for p in self.pieces]
        # A piece that merging never yields is never used.
        usable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.shorter = [-1] * n  # the next shorter usable piece that starts a piece
        self.machine = ahocorasick.Automaton()
        for p, i in usable.items():
            self.machine.add_word(p, (len(p) - 1, i))
            self.shorter[i] = next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1)
        self.machine.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.runs = _Memory(self._bytes_of)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.newline_apart = "\n" not in self.letters

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text by the definition: the best-scored pair first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces anew gives the two pieces."""
        x, y = self.pieces[a], self.pieces[b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 24 | b] = self.merge(x + y) == [x, y]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Encode a text of vocabulary characters."""
        n = len(text)
        longest = [0] * n
        for end, (back, i) in self.machine.iter(text):  # by growing end, so the longest stays
            longest[end - back] = i
        length, shorter, known = self.length, self.shorter, self.pairs
        failed = bytearray(n // 8 + 1)  # a bit for each position from which nothing fits
        out: list[int] = []
        pos, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = pos + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = known.get(last << 24 | piece)
                    if fits is None:
                        fits = self.compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == n:
                    return out
                pos, last, piece = end, piece, longest[end]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= length[piece]
                piece = shorter[piece]
                last = out[-1] if out else -1

    def encode_run(self, run: str) -> list[int]:
        if self.letters.issuperset(run):
            return self._backtrack(run) if run else []
        out: list[int] = []
        start = 0
        for k, c in enumerate(run):
            if c not in self.letters:
                if start < k:
                    out += self._backtrack(run[start:k])
                out += [self.byte_id[b] for b in c.encode("utf-8")]
                start = k + 1
        if start < len(run):
            out += self._backtrack(run[start:])
        return out

    def _bytes_of(self, word: str) -> bytes:
        """The ids of a word after a space, or of a line break and what follows it."""
        return np.array(self.encode_run(word if word[:1] == "\n" else MARK + word), np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.newline_apart and MARK not in text and "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
            data = b"".join(map(self.runs.__getitem__, text.replace("\n", " \n").split(" ")))
            self.runs.trim()
            return np.frombuffer(data, np.int32)
        runs = self.split(MARK + text.replace(" ", MARK))
        return np.fromiter(chain.from_iterable(map(self.encode_run, runs)), np.int32)

    def decode(self, ids) -> str:
        """The text of ids: the space put before the text goes, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int32)
        if not len(ids):
            return ""
        surface, listed = self.surface, ids.tolist()
        where = np.flatnonzero(self.partial[ids])
        if not len(where):
            text = "".join(map(surface.__getitem__, listed))
        else:
            parts, done = [], 0
            for group in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
                a, b = int(group[0]), int(group[-1]) + 1
                parts += map(surface.__getitem__, listed[done:a])
                parts.append(_utf8(bytes(self.byte_of[i] for i in listed[a:b])))
                done = b
            parts += map(surface.__getitem__, listed[done:])
            text = "".join(parts)
        first = next((i for i in listed if i not in self.control), None)
        if first is not None and self.pieces[first].startswith(MARK):
            text = text[1:]
        return text


class _Memory(dict):
    """Encodings of the words met lately, in two generations of bounded size."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= RUN_CHARS:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > RUNS:
            self.old = dict(self)
            self.clear()


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):  # one U+FFFD for each byte that starts no character
            for n in (1, 2, 3, 4):
                try:
                    c = data[i : i + n].decode("utf-8")
                    break
                except UnicodeDecodeError:
                    c = ""
            out.append(c or "�")
            i += n if c else 1
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """This worker's codec; kept so that later tasks find its memory warm."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def _apply(df: DataFrame, schema: str, columns: list[str], make) -> DataFrame:
    """Add columns made row by row from an Arrow batch, whatever other columns there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch)

    return df.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row."""
    model = model_file or default_model()
    id_type = docs.schema[id_col].dataType

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return _apply(docs, f"id {id_type.simpleString()}, ids array<int>", [id_col, text_col], make)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(id, text) for every row of (id, ids)."""
    model = model_file or default_model()
    id_type = encoded.schema["id"].dataType

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        text = [c.decode([] if x is None else x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])

    return _apply(encoded, f"id {id_type.simpleString()}, text string", ["id", "ids"], make)


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts."""
    model = model_file or default_model()
    id_type = docs.schema[id_col].dataType

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        n, a, b = [], [], []
        for k in range(batch.num_rows):
            ids = c.encode(batch.column(1)[k].as_py())
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(c.numbers.__getitem__, ids.tolist())).encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _apply(docs, f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", [id_col, text_col], make)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip_digests(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
