"""Fuzzy line dedup by MinHash (operator 7), in DataFrame operations only.

Lines are sets of character 9-grams.  Of a line's n-gram hashes, MinHash keeps the nearest to each of
16 fixed points (the least of hash XOR point); 8 bands of three minima each bring lines of similarity
0.8 together with a probability of 99 % (of 0.9: above 99.9 %).  Each line of a bucket is paired with
the bucket's least; pairs are verified by exact Jaccard similarity on whole n-gram sets; links are
joined into components by distributed union-find.  Then all lines of a bucket that are still in
different components are compared with each other, so every pair that shares a bucket is decided; of
each component the earliest line stays.

Scale: n-grams are made and reduced to minima within generated code, one pass over the text, whose
shuffle has 16 numbers for each distinct line of a task; so equal lines are one from there on, and a
line in a third of all documents is one row.  Lines alike to their bucket's least cost one pair each.
Only the rest of a bucket is compared pairwise (quadratic in lines that share a bucket and aren't
linked), in blocks of bounded size, so that a large bucket is dealt over many tasks.  Texts are
shuffled only for lines that have a pair, and as text: n-gram sets are made where they are compared.

Defined results: a line's form is its text in lower case, runs of ASCII white space as one space,
trimmed; characters are UTF-16 units; lines of an empty form always stay; forms shorter than nine
characters match only equal ones; a null text has no lines; a line of any length is one line, its
n-grams taken in blocks; order is by document id, then line number, a null id coming first; rows that
repeat an id share their lines' fate; an empty table gives no rows; further columns are ignored, and
passed through by ``drop_lines`` whatever their names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import Scratch, apart_blocks, components, documents, key_filter, let, quoted

K, HASHES, BANDS, ROWS = 9, 16, 8, 3
#: Lines of a bucket that are compared at once.
BLOCK = 256
#: Pairs with one line that are verified in one task.
STAR = 1024
#: N-grams of a line that are listed at once.
GRAMS = 1 << 16
#: N-grams that are hashed in one row.
STEP = 16
#: Least similarity.
SIMILAR = 80  # percent


def points() -> list[int]:
    """Where minima are taken: one point in each sixteenth of the hashes."""
    r = random.Random(7)
    return [(j << 60 | r.getrandbits(60)) - (1 << 63) for j in range(HASHES)]


def bands() -> list[tuple[int, ...]]:
    """The minima of each band: a fixed choice in which they are used equally often."""
    r, out, pool = random.Random(5), [], []
    while len(out) < BANDS:
        if len(pool) < ROWS:
            pool += r.sample(range(HASHES), HASHES)
        band = []
        while len(band) < ROWS:
            band.append(pool.pop(next(i for i, x in enumerate(pool) if x not in band)))
        out.append(tuple(sorted(band)))
    return out


def form(line: Column) -> Column:
    # Most lines have single spaces only; for those no regular expression runs.
    odd = F.greatest(*[line.contains(x) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, form) for every line of every document."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "raw"))
    return rows.select("id", "line", form(F.col("raw")).alias("form"))


def _keys(form_: Column) -> list[Column]:
    return [F.xxhash64(form_).alias("l1"), F.xxhash64(form_, F.lit(1)).alias("l2")]


def _wide(form_: Column) -> Column:
    """A text with two bytes for each character."""
    return F.encode(form_, "UTF-16BE")


def _last(wide: Column) -> Column:
    return (F.length(wide) / 2).cast("int") - K


def gram(wide: Column, at: Column) -> Column:
    """Hash of the n-gram at a byte of a wide text, counted from 1."""
    return F.xxhash64(F.substring(wide, at, F.lit(2 * K)))


def grams(rows: DataFrame) -> DataFrame:
    """(l1, h0 ... h15): the n-gram hashes of (l1, form) rows, STEP to a row; lines without an n-gram have no rows."""
    # The wide text is a column below the explosions, so it is made once for a line.
    # Short lines explode to nothing; a filter on the length would make every form a second time.
    wide = rows.select("l1", _wide(F.col("form")).alias("wide")).withColumn("last", _last(F.col("wide")))
    starts = wide.select("l1", "wide", "last", F.explode(F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.greatest("last", F.lit(0)), F.lit(GRAMS)))).alias("start"))
    places = starts.select("l1", "wide", "last", F.explode(F.sequence("start", F.least(F.col("start") + (GRAMS - 1), "last"), F.lit(STEP))).alias("i"))
    # Places beyond the last are the last again, which changes no minimum and no set.
    return places.select("l1", *[gram(F.col("wide"), F.least(F.col("i") + k, F.col("last")) * 2 + 1).alias(f"h{k}") for k in range(STEP)])


def minima(rows: DataFrame) -> DataFrame:
    """(l1, m0 ... m15) for lines that have an n-gram."""
    # The least of some n-grams is taken within the row, so that fewer rows meet the aggregate.
    near = lambda p: F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(p)) for k in range(STEP)])
    return grams(rows).groupBy("l1").agg(*[F.min(near(p)).alias(f"m{j}") for j, p in enumerate(points())])


def gram_set(form_: Column) -> Column:
    listed = lambda w: F.transform(F.sequence(F.lit(1), _last(w) * 2 + 1, F.lit(2)), lambda at: gram(w, at))
    # Never null, so that no check for nulls makes a set again.
    return F.coalesce(F.array_distinct(let(_wide(form_), listed)), F.array().cast("array<bigint>"))


def _alike(x: str, y: str) -> Column:
    """Exact Jaccard similarity of two n-gram sets, SIMILAR percent at least; sets of too different sizes aren't intersected."""
    sizes = 100 * F.least(F.size(x), F.size(y)) >= SIMILAR * F.greatest(F.size(x), F.size(y))
    return sizes & ((100 + SIMILAR) * F.size(F.array_intersect(x, y)) >= SIMILAR * (F.size(x) + F.size(y)))


def similar(pairs: DataFrame, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, ...) that are similar; many pairs may have one b, so many of them at once."""
    centres = scratch.keep(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")), "centres")
    # Texts are shuffled; sets are made after the shuffle.
    x = pairs.join(centres, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts")).join(forms, F.col("a") == F.col("l1"))
    x = x.repartition("b", "part").select(*pairs.columns, "part", gram_set(F.col("form")).alias("x"))
    y = centres.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(forms, F.col("b") == F.col("l1"))
    y = y.repartition("b", "part").select("b", "part", gram_set(F.col("form")).alias("y"))
    return scratch.keep(x.join(y, ["b", "part"]).where(_alike("x", "y")).select(*pairs.columns), "stars")


def _mixed(rest: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components; a bucket of two lines was decided with its least."""
    held = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rest.join(held.where("low < high AND n > 2").select("band"), "band")


def similar_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) pairs of line keys that are verified as similar; they connect all similar lines that share a bucket."""
    keys = [F.xxhash64(F.lit(i), *[F.col(f"m{j}") for j in band]) for i, band in enumerate(bands())]
    keyed = scratch.keep(minima(rows).select("l1", F.array(*keys).alias("bands")), "bands")
    banded = keyed.select("l1", F.explode("bands").alias("band"))
    # Nearly every band is of one line, so a partial aggregate would save nothing.
    dealt = banded.repartition("band")
    shared = dealt.groupBy("band").agg(F.min("l1").alias("low"), F.max("l1").alias("high")).where("low < high").select("band", "low")
    # Every line of a bucket, with the bucket's least.
    held = scratch.keep(dealt.join(shared, "band"), "held")

    # Exact similarity with the bucket's least.
    pairs = scratch.keep(held.where("l1 <> low").select(F.col("l1").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    asked = held.select("l1").distinct()
    forms = key_filter(rows.select("l1", "form"), "l1", asked).groupBy("l1").agg(F.min("form").alias("form"))
    forms = scratch.keep(forms, "forms")
    links = similar(pairs, forms, scratch)

    # Buckets that hold several components after that: their lines are compared across components.
    found = scratch.keep(components(links, scratch).distinct(), "found")
    rest = held.join(found, F.col("l1") == F.col("node"), "left").select("band", "l1", F.coalesce("component", "l1").alias("component"))
    mixed = scratch.keep(_mixed(scratch.keep(rest, "rest")), "mixed")
    tagged, blocks = apart_blocks(mixed, "band", "l1", scratch, BLOCK)
    tagged = scratch.keep(tagged.join(keyed, "l1").select("band", "big", "only", "part", "l1", "bands", "component"), "tagged")
    blocks = scratch.keep(blocks, "pairs")
    scratch.drop(held, mixed)

    def side(pairs: DataFrame, block: str, x: str) -> DataFrame:
        wanted = pairs.select("band", "p", "q", *[F.col(f"{block}.{c}").alias(c) for c in ("big", "only", "part")])
        return wanted.join(tagged, ["band", "big", "only", "part"]).select("band", "p", "q", *[F.col(c).alias(f"{c}_{x}") for c in ("l1", "bands", "component")])

    def with_sets(rows: DataFrame, x: str) -> DataFrame:
        texts = rows.join(forms.select(F.col("l1").alias(f"l1_{x}"), "form"), f"l1_{x}").repartition("band", "p", "q")
        return texts.withColumn(f"set_{x}", gram_set(F.col("form"))).drop("form")

    # Pairs that share several buckets are compared in the first of them; lines without a pair to compare are left out.
    same = F.coalesce(*[F.when(F.col("bands_a")[i] == F.col("bands_b")[i], F.col("bands_a")[i]) for i in range(BANDS)])
    among = blocks.where("NOT q.big")
    left, right = scratch.keep(side(among, "p", "a"), "left"), scratch.keep(side(among, "q", "b"), "right")
    x, y = left.alias("x"), right.alias("y")
    block = (F.col("x.band") == F.col("y.band")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    apart = (F.col("component_a") != F.col("component_b")) & ((F.col("x.p") != F.col("x.q")) | (F.col("l1_a") < F.col("l1_b"))) & (same == F.col("x.band"))
    asked_a, asked_b = x.join(y, block & apart, "left_semi"), y.join(x, block & apart, "left_semi")
    left, right = scratch.keep(asked_a, "left"), scratch.keep(asked_b, "right")
    x, y = with_sets(left, "a").alias("x"), with_sets(right, "b").alias("y")
    second = x.join(y, block & apart & _alike("set_a", "set_b")).select(F.col("l1_a").alias("a"), F.col("l1_b").alias("b"))
    # One link with a large component is enough for a line.
    beside = blocks.where("q.big")
    x, y = with_sets(side(beside, "p", "a"), "a").alias("x"), with_sets(side(beside, "q", "b"), "b").alias("y")
    third = x.join(y, block & _alike("set_a", "set_b"), "left_semi").select(F.col("l1_a").alias("a"), F.col("q.only").alias("b")).distinct()
    second = scratch.keep(second.union(third), "rest-links")
    scratch.drop(tagged, blocks, forms, keyed, left, right)
    return links.union(second)


def _place(rows: DataFrame) -> Column:
    """The order of lines: by id, a null one first, then by number; a number where ids are, so that it is aggregated in place."""
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        low = F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")
        return (F.coalesce(F.col("id").cast("decimal(20,0)"), low) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line")).cast("decimal(38,0)")
    return F.struct("id", "line")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, blank, exact, kept) for every line; exact: an equal line is earlier."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = lines(docs, id_col, text_col)
    rows = scratch.keep(rows.select("id", "line", "form", *_keys(F.col("form"))), "lines")
    links = scratch.keep(similar_pairs(rows, scratch), "links")
    found = scratch.keep(components(links, scratch).distinct(), "found")
    at = rows.select("id", "line", (F.col("form") == "").alias("blank"), "l1", "l2").withColumn("place", _place(rows))
    equal = at.where("NOT blank").groupBy("l1", "l2").agg(F.min("place").alias("first_equal"), F.count(F.lit(1)).alias("n"))
    equal = scratch.keep(equal, "equal")
    # Lines without a link go by their equals only; those with one by their component.  A line with neither stays.
    nodes = found.withColumnRenamed("node", "l1")
    linked = scratch.keep(key_filter(equal, "l1", nodes).join(nodes, "l1").select("l1", "l2", "component", "first_equal"), "linked")
    first = linked.groupBy("component").agg(F.min("first_equal").alias("first"))
    repeated = equal.where("n > 1").join(nodes, "l1", "left_anti").select("l1", "l2", "first_equal", F.col("first_equal").alias("first"))
    verdict = scratch.keep(linked.join(first, "component").select("l1", "l2", "first_equal", "first").union(repeated), "verdict")
    out = at.join(verdict, ["l1", "l2"], "left")
    kept = F.col("blank") | F.coalesce(F.col("place") == F.col("first"), F.lit(True))
    exact = F.coalesce(F.col("place") != F.col("first_equal"), F.lit(False)) & ~F.col("blank")
    return out.select("id", "line", "blank", exact.alias("exact"), kept.alias("kept"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay as their text."""
    gone = decide(docs, id_col, text_col).where("NOT kept").groupBy("id").agg(F.collect_set("line").alias("gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["id"]), "left")
    stay = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x, i: ~F.array_contains(gone["gone"], i)), "\n")
    text = F.when(gone["gone"].isNull(), docs[text_col]).otherwise(stay)
    return joined.select(*[text.alias(c) if c == text_col else docs[quoted(c)] for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with a text: its lines, those kept, those removed as equal and as similar to an earlier one."""
    d = decide(documents(spark, sf_dir))
    removed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line")))).cast("array<string>"), ",")
    return d.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(~F.col("kept") & F.col("exact")).alias("n_equal"),
        F.count_if(~F.col("kept") & ~F.col("exact")).alias("n_similar"),
        removed.alias("removed_lines"),
    )
