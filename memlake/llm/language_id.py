"""Language ID by hyperdimensional profiles (operator 3).

Every letter has a pseudo-random vector of +1 and -1, derived from its code point alone.  An n-gram's
vector binds its letters' vectors, each permuted (rolled) by its place; a document bundles (sums) the
vectors of its n-grams; a language's prototype bundles its labelled documents at unit length.  A
document gets the language whose prototype has the largest cosine with it.

Scale: texts are read where they lie and never shuffled; fitting sends one partial prototype for each
language and task, and what tasks close over are languages x dimensions floats.

Defined results: the language of a text that is null or has no letter is ``und`` with score 0; ties
go to the first language by name; with no labelled documents all are ``und``; rows are independent,
so repeated rows, empty tables and further columns need nothing special.  Texts of any length are
read whole, in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import as_row, documents, quoted

UNKNOWN = "und"
DIM = 1024
N = 3
#: Documents bundled for prototypes at most, about: a uniform sample by hash if more are labelled.
SAMPLE = 200_000
#: Characters handled at once.
PIECE = 1 << 17

_letters = re.compile(r"[^\W\d_]+").findall


class Hyperspace:
    """The random vectors and the bundling of documents; the same in every process."""

    def __init__(self, dim: int = DIM, n: int = N):
        self.dim, self.n = dim, n
        self.known = np.zeros(0, np.int64)
        self.vectors: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        v = self.vectors.get(code)
        if v is None:
            v = self.vectors[code] = np.random.default_rng([code, 7919]).choice(np.array([-1, 1], np.int8), self.dim)
        return v

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters of the text as code points, runs of other characters as one space."""
        words = _letters(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Document vectors (texts x dim), and which texts have a letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        some = np.zeros(len(texts), bool)
        batch: list[tuple[int, np.ndarray]] = []
        held = 0
        for k, text in enumerate(texts):
            codes = self.codes(text)
            some[k] = len(codes) > 0
            for a in range(0, max(0, len(codes) - self.n + 1), PIECE):
                part = codes[a : a + PIECE + self.n - 1]
                batch.append((k, part))
                held += len(part)
                if held >= 2 * PIECE or len(batch) >= 128:
                    self._add(batch, out)
                    batch, held = [], 0
        if batch:
            self._add(batch, out)
        return out, some

    def _add(self, batch: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        letters, local = np.unique(np.concatenate([c for _, c in batch]), return_inverse=True)
        u = len(letters)
        grams, rows, at = [], [], 0
        for j, (_, c) in enumerate(batch):
            x = local[at : at + len(c)]
            at += len(c)
            m = len(c) - self.n + 1
            key = np.zeros(m, np.int64)
            for p in range(self.n):
                key = key * u + x[p : p + m]
            grams.append(key)
            rows.append(np.full(m, j, np.int64))
        key, row = np.concatenate(grams), np.concatenate(rows)
        size = u**self.n
        if size <= 1 << 22:
            seen = np.zeros(size, bool)
            seen[key] = True
            found = np.flatnonzero(seen)
            place = np.zeros(size, np.int64)
            place[found] = np.arange(len(found))
            column = place[key]
        else:
            found, column = np.unique(key, return_inverse=True)
        base = np.stack([self.letter(int(c)) for c in letters])
        docs = [k for k, _ in batch]
        # In slices of n-grams, so that neither factor of the product grows with the batch's variety.
        counts = np.bincount(row * len(found) + column, minlength=len(batch) * len(found)).reshape(len(batch), len(found))
        for a in range(0, len(found), 4096):
            rest = found[a : a + 4096]
            bound = np.ones((len(rest), self.dim), np.int8)
            for p in range(self.n - 1, -1, -1):
                bound *= np.roll(base, p, axis=1)[rest % u]
                rest = rest // u
            total = counts[:, a : a + 4096].astype(np.float32) @ bound.astype(np.float32)
            np.add.at(out, docs, total)


_spaces: dict[tuple[int, int], Hyperspace] = {}


def space(dim: int, n: int) -> Hyperspace:
    return _spaces.setdefault((dim, n), Hyperspace(dim, n))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = N, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Language names and prototypes (languages x dim, unit length) from labelled rows.

    At most about ``sample`` rows are bundled: if more are labelled, those whose text hashes below a
    threshold, so that any rows of the table may be among them.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * sample / total))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper, sums = space(dim, n), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                vectors, some = hyper.bundle(texts[a : a + 256])
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                for lang, v, ok in zip(langs[a : a + 256], vectors, some, strict=True):
                    if ok:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        langs = list(sums)
        # Rounded to whole millionths: sums are then exact, whatever the order in which parts meet.
        parts = [np.rint(sums[x] * 1e6).astype(np.int64) for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(partial, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in got]
    vectors = np.array([[x["x"] for x in r["v"]] for r in got], np.float64).reshape(len(names), dim if names else 0)
    return names, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", dim: int = DIM, n: int = N, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score (the cosine, 0 at least) appended; a clashing column is replaced."""
    names, prototypes = model
    kept = [c for c in docs.columns if c not in out]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper = space(dim, n)
        for batch in batches:
            pred, score = [], []
            for a in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(at).slice(a, 256).to_pylist()]
                if not names:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                vectors, some = hyper.bundle(texts)
                cos = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(axis=1)
                pred += [names[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
                score += [round(float(min(1.0, max(0.0, cos[k, b]))), 4) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, some, strict=True))]
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out])

    columns = [docs[quoted(c)] for c in kept]
    schema = docs.select(*columns).schema.add(out[0], "string").add(out[1], "double")
    return docs.select(*columns).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Documents that are never learnt from; a null id is learnt from neither way and counts as not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with an identified language, as they were; those without any letter go."""
    # The row is a struct, so the prediction's columns clash with none of it.
    rows = docs.select(as_row(docs).alias("row"), docs["text"].alias("text"))
    return predict(rows, fit_documents(docs)).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_documents(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
