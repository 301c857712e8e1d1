"""Fill-in-middle transformation at token boundaries (operator 13).

A text is a sequence of units: a run of other characters with the white space before it, and white space
at the end.  One Aho-Corasick automaton scans the text for its events: the ASCII characters at which the
class of characters may change (white space) and the sentinels.  A gap between two events that are not
neighbours is a run, and its end the end of a unit, so the ends of runs, kept as a plain array of
positions, are all that is needed to count units and to look up where the k-th one ends.

Two cut points, drawn by hash of the id, part a text into prefix, middle and suffix, which are put into
prefix-suffix-middle or suffix-prefix-middle order behind sentinels.  ``restore`` undoes that.

Scale: one pass in the input's own partitions and no shuffle; a text at a time is in a Python worker, with
eight bytes for each of its units.  Digests, and the way back, are built-in functions.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, is plain, so each
sentinel stands once in an arranged text; white space alone is one unit; texts of any length are scanned
whole; a null id draws as an empty one; cut points may coincide, which makes an empty middle, and lie at
either end; repeated rows are arranged alike; an empty table gives no rows; further columns are neither
read nor returned, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = " \t\n\v\f\r"
SEED = "42"
#: Share of texts that are arranged, and of those in suffix-prefix-middle order, in hundredths.
RATE, SPM = 50, 80
BATCH = 256

ARRANGED = "id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in SPACES:
        a.add_word(c, False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, True)
    a.make_automaton()
    return a


def scan(text: str) -> tuple[array, bool]:
    """(ends, marked): where each unit ends, in characters, and whether the text holds a sentinel."""
    ends, marked, before = array("q"), False, -1
    for at, sentinel in automaton().iter(text):
        if sentinel:
            marked = True
        else:
            if at - before > 1:
                ends.append(at)
            before = at
    # Past the last event there is another run, or the white space ends the text; both end the last unit.
    if text:
        ends.append(len(text))
    return ends, marked


def draws(name: str, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the seed and the id."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def arrange(name: str, text: str, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    ends, marked = scan(text)
    n = len(ends)
    a, b, c, d = draws(name, seed)
    if not text or marked or c % 100 >= rate:
        return n, "plain", None, None, text
    k, m = sorted((a % (n + 1), b % (n + 1)))
    p, q = (ends[x - 1] if x else 0 for x in (k, m))
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if d % 100 < spm:
        return n, "spm", p, q - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", p, q - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row; n counts units, the others code points."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("text"))
    schema = ARRANGED.format(id=rows.schema["id"].dataType.simpleString())
    types = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                ids, names, texts = (c.slice(a, BATCH) for c in b.columns)
                made = [arrange(n or "", t or "", seed, rate, spm) for n, t in zip(names.to_pylist(), texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(types)[1:], strict=True)]], schema=types)

    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    middle = F.substring_index(output, MIDDLE, -1)
    outer = F.substring_index(output, MIDDLE, 1)

    def parted(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(outer, second, 1)
        return F.substring(head, F.lit(len(first) + 1), F.length(head)), F.substring_index(outer, second, -1)

    prefix, suffix = parted(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = parted(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM c
"""
