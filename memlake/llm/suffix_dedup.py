"""Suffix dedup by depth-limited radix sort (operator 4).

Suffixes, cut at ``length`` bytes (windows), are sorted by most-significant-digit passes; a group of
equal windows is found when the passes reach the full length, and every window of a group but the
first marks its bytes for removal.  Groups of one leave after each pass, so little is left of the data
after the first:

pass 1  digit: the window's anchor, the 32 bytes in it with the smallest hash.  Windows that follow
        each other mostly have the same anchor and are handled as one run (first window, count).
pass 2  digit: the whole content of the run.  Of runs with equal content all but the first are
        repeated in full; an anchor with one content is done.
pass 3  digit: 93 bytes, common to eight windows at aligned distances from the anchor; then those
        eight windows' content.
pass 4  digit: the window itself, for the few that are left - those where a repeated passage ends.

Scale: texts are read where they lie in passes 1 and 2, which shuffle one narrow row for about 32
bytes of text; contents move for the runs that reach pass 3, and a last join by id brings each text to
its marks.  Groups are reduced to their first member by aggregates that combine before the shuffle,
and joined back by plain joins that Spark can split, so a passage in a third of all documents is fine.

Defined results: a null text is empty; a text shorter than ``length`` is never reduced; matches never
cross documents; a document with a null id is neither compared nor reduced; rows that repeat an id
and its text are one document; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import Scratch, documents

LENGTH, ANCHOR = 100, 32
#: Windows handled at once; runs are cut there, which the later passes undo.
SEGMENT = 1 << 21
#: Windows that share a digit in pass 3.
STEP = 8

_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64)
_power = {_ODD: np.ones(1, np.uint64), pow(_ODD, -1, 1 << 64): np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    p = _power[base]
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _power[base] = p
    return p[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, windows, anchor place) of each run of windows of some bytes."""
    n = len(data)
    span = length - anchor + 1
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_ODD, n), out=pre[1:])
    back = _powers(pow(_ODD, -1, 1 << 64), n)
    h = _mix((pre[anchor:] - pre[:-anchor]) * back[: n - anchor + 1])
    # The least hash in each window, leftmost of equals: place in the low bits; minima of blocks from both ends.
    bits = np.uint64(24)
    ranked = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    padded = np.concatenate([ranked, np.full(-len(h) % span, ~np.uint64(0), np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    at = place[first]
    content = (pre[first + count - 1 + length] - pre[first]) * back[first]
    content = _mix(content + _mix((count << 20 | (at - first)).astype(np.uint64)))
    return h[at].view(np.int64), content.view(np.int64), first, count, at


def _segments(text: str | None, length: int) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    for a in range(0, len(data) - length + 1, SEGMENT):
        yield a, data[a : a + SEGMENT + length - 1]


def anchors(docs: DataFrame, id_col: str, text_col: str, placed: bool) -> DataFrame:
    """(h, c) for every run, and with ``placed`` also (doc, first, packed): count and distance to the anchor in packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for k, text in enumerate(b.column(1)):
                if ids[k] is None:
                    continue
                for a, data in _segments(text.as_py(), LENGTH):
                    h, c, first, count, at = runs(data)
                    out.append((h, c, np.full(len(h), ids[k], np.int64), first + a, count << 8 | (at - first)) if placed else (h, c))
                    held += len(h)
                    if held > 50_000:
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    names = ["h", "c", "doc", "first", "packed"] if placed else ["h", "c"]

    def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _first(*position: str) -> Column:
    return F.min(F.struct(*position)).alias("earliest")


def repeated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lo, hi): byte ranges, each a union of windows that also start earlier; every such window is in one."""
    spark = docs.sparkSession
    where = F.struct("doc", "first")

    # Pass 1: anchors that occur once leave.
    once = anchors(docs, id_col, text_col, placed=False).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("a"), F.max("c").alias("b"))
    again = scratch.keep(once.where("n > 1").select("h", (F.col("a") != F.col("b")).alias("several")), "again")
    found = scratch.keep(anchors(docs, id_col, text_col, placed=True).join(again, "h"), "found")
    scratch.drop(again)

    # Pass 2: runs with equal content.
    classes = scratch.keep(found.groupBy("h", "c").agg(_first("doc", "first"), F.first("several").alias("several"), F.first("packed").alias("packed")), "classes")
    later = found.select("h", "c", "doc", "first", "packed").join(classes.select("h", "c", "earliest"), ["h", "c"]).where(where != F.col("earliest"))
    marks = scratch.keep(later.select("doc", F.col("first").alias("lo"), (F.col("first") + F.shiftright("packed", 8) - 1 + LENGTH).alias("hi")), "marks")

    scratch.drop(found)

    # Pass 3: of anchors with several contents, each content's first run, with its bytes.
    heads = classes.where("several").select("earliest.doc", "earliest.first", F.shiftright("packed", 8).cast("int").alias("count"), F.col("packed").bitwiseAND(255).cast("int").alias("reach"))
    heads = heads.groupBy("doc").agg(F.collect_list(F.struct("first", "count", "reach")).alias("heads"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.col(text_col), "UTF-8").alias("_data"))
    texts = texts.join(heads, F.col("_id") == F.col("doc")).dropDuplicates(["doc"])
    cut = F.transform("heads", lambda x: F.struct(x["first"].alias("run"), x["count"].alias("count"), x["reach"].alias("reach"), F.substring(F.col("_data"), (x["first"] + 1).cast("int"), x["count"] + LENGTH - 1).alias("bytes")))
    heads = scratch.keep(texts.select("doc", F.inline(cut)), "heads")
    scratch.drop(classes)
    # Distances to the anchor are reach, reach - 1, ... reach - count + 1; aligned pieces of STEP of them.
    near = F.col("reach") - F.col("count") + 1
    pieces = heads.select("*", F.explode(F.sequence(F.floor(near / STEP).cast("int"), F.floor(F.col("reach") / STEP).cast("int"))).alias("piece"))
    top = F.least(F.col("reach"), F.col("piece") * STEP + STEP - 1)
    pieces = pieces.withColumn("skip", F.col("reach") - top).withColumn("windows", top - F.greatest(near, F.col("piece") * STEP) + 1)
    # The bytes all windows of the aligned piece have: from its nearest distance on, STEP - 1 fewer than a window.
    core = F.expr(f"substring(bytes, reach - piece * {STEP} + 1, {LENGTH - STEP + 1})")
    body = F.expr(f"substring(bytes, skip + 1, windows + {LENGTH - 1})")
    digit = [F.xxhash64("piece", core).alias("core"), F.unhex(F.md5(F.concat(body, F.concat_ws(":", top, "windows", "piece").cast("binary")))).alias("all")]
    pieces = pieces.select("doc", "run", "skip", "windows", *digit)
    alike = pieces.select("core", F.xxhash64("all").alias("x")).groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).where("n > 1")
    alike = scratch.keep(alike.select("core", (F.col("a") != F.col("b")).alias("several")), "alike")
    left = scratch.keep(pieces.join(alike, "core").withColumn("first", F.col("run") + F.col("skip")), "left")
    groups = left.groupBy("core", "all").agg(_first("doc", "first"))
    groups = scratch.keep(groups, "groups")
    told = left.select("core", "all", "doc", "first", "windows").join(groups.select("core", "all", "earliest"), ["core", "all"])
    marks3 = scratch.keep(told.where(where != F.col("earliest")).select("doc", F.col("first").alias("lo"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("hi")), "marks")

    # Pass 4: the windows of what is left, from the bytes of the runs they are in.
    first = left.where("several").join(groups.select("core", "all", "earliest"), ["core", "all"]).where(where == F.col("earliest"))
    first = first.select("doc", "run", "skip", "windows").distinct()
    single = heads.select("doc", "run", "bytes").join(first, ["doc", "run"])
    single = single.select("doc", (F.col("run") + F.col("skip")).alias("first"), "skip", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("w"))
    single = single.select("doc", (F.col("first") + F.col("w")).alias("first"), F.unhex(F.md5(F.expr(f"substring(bytes, skip + w + 1, {LENGTH})"))).alias("window"))
    single = scratch.keep(single, "single")
    scratch.drop(heads, left, groups, alike)
    earliest = scratch.keep(single.groupBy("window").agg(_first("doc", "first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "earliest")
    marks4 = single.join(earliest, "window").where(where != F.col("earliest")).select("doc", F.col("first").alias("lo"), (F.col("first") + LENGTH).alias("hi"))
    return marks.union(marks3).union(scratch.keep(marks4, "marks"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[start], hi[np.concatenate([start[1:], [True]])]


_RUNS = "array<struct<lo:long,hi:long>>"


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, runs): each document with its maximal removed byte runs."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    marks = repeated(docs, scratch, id_col, text_col)
    marks = scratch.keep(marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(marks, F.col("id") == F.col("doc"), "left").select("id", "text", "runs")


def reduced(removed: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of (id, text, runs)."""
    id_type = removed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                if not ranges.is_valid or not len(ranges):
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), []))
                    continue
                both = ranges.values
                lo, hi = merged(both.field(0).to_numpy(), both.field(1).to_numpy())
                kept, at = hashlib.sha256(), 0
                view = memoryview(data)
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept.update(view[at:x])
                    at = y
                kept.update(view[at:])
                spans = [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                rows.append((len(data), int((hi - lo).sum()), len(lo), kept.hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return removed.select("id", "text", "runs").mapInArrow(run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_RUNS}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reduced(removal(documents(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
