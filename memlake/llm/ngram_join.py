"""N-gram Jaccard self-join by a token-group matrix (operator 8).

Documents are sets of word n-grams; two link if their Jaccard similarity is ``percent`` or more, and
the result is each document's component.  Exact at every size, in four steps:

1. Groups of similar documents.  Let two sets of at most s elements link: they differ in at most d
   elements (at 85 percent d = 0.15 / 1.85 * 2s).  Cut the space of n-gram hashes into K > d ranges: at
   least K - d ranges then hold the same elements of both.  So the signature (range, its elements) of
   some non-empty range is equal, and documents chained by equal signatures form the groups; no link
   crosses them.  (Sets so spread that K - d or more ranges are empty also sign their empty ranges.)
   Sizes are handled in classes.  As a set shares K - d signatures with each of its partners, it can
   do without the K - d - 1 (less its empty ranges) that most sets have: the rarest signature of a
   linked pair is never among them.  So a passage in a third of all documents chains no strangers.
2. The token-group matrix: for each group the union of its members' n-grams, and for an n-gram of one
   member only, that member.  A document's overlap with the rest of its group is the number of its
   n-grams that another member has; a document with an overlap below the threshold's share of its size
   links with no one.  Of the others the groups are formed anew.
3. Only groups with two documents left are opened.  Members are compared in blocks of bounded size,
   each with a few pivots of the group, by one matrix product; a block emits a spanning forest of
   its links, so results are linear in members.
4. Members of a group of several blocks that step 3 left in different components are compared if they
   have one of the rarest n-grams of both in common, as two that link must: of each set the first
   n - ceil(percent * n / 100) + 1 by rarity.  First each meets one member of such an n-gram, so near
   copies find their component; then all pairs that are still apart meet.  What moves grows with the
   members and such pairs, not with the pairs of blocks.

Documents with equal sets are one member from the start, so copies cost nothing.  Signatures and
the matrix's n-grams are shuffled once, in passes of which only one is on disk; all else moves ids and
sizes, and a set only to the block that it is compared in.
Small and large inputs run the same plan.

Defined results: a null text, or one without words, has the empty set and is a component of its own;
fewer than n words are one n-gram; texts of any length are taken whole; a null id takes no part in
links and keeps a null component; repeated rows are copies; of rows that repeat an id with different
texts each takes part under that id; among links of equal similarity none is preferred, all count; an
empty table gives no rows; further columns are ignored, and passed through by ``keep_one`` whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import BLOCK, Scratch, as_row, components, documents, key_filter, quoted, told

N = 5
#: Least similarity, as percent: 100 * intersection >= PERCENT * union.
PERCENT = 80
PIVOTS = 8
#: Signatures or n-grams that are shuffled at once, and bounds of the number of passes: each reads the table again.
PASS = 1 << 27
LEAST_PASSES, MOST_PASSES = 4, 16
#: Turns in which members meet one of each n-gram only, before all pairs that are left do.
ROUNDS = 2
#: Words whose hashes a worker remembers before it starts anew.
WORDS = 150_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(text: str | None, n: int = N) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    if len(_words) > WORDS:
        _words.clear()
    get, one = _words.get, xxhash.xxh3_64_intdigest
    codes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _words[w] = one(w)
        codes[i] = h
    m = len(words) - n + 1
    out = codes[:m].copy()
    for k in range(1, n):
        out = _mix(out) + codes[k : k + m]
    return np.unique(_mix(out))


class Classes:
    """Size classes: a class's sizes are in [bounds[c], bounds[c + 1]); linked sets are in one or in two next to each other."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1]

    def _grow(self) -> None:
        self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // self.percent)))

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self._grow()
        return bisect_right(self.bounds, n) - 1

    def ranges(self, c: int) -> tuple[int, int]:
        """(d, K) for pairs whose larger set is in class c."""
        while len(self.bounds) < c + 2:
            self._grow()
        top = self.bounds[c + 1] - 1
        d = (100 - self.percent) * 2 * top // (100 + self.percent)
        return d, d + 1 + (1 + d // 16 if d > 2 else 0)


_classes: dict[int, Classes] = {}


def signatures(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, tuple[int, int]]:
    """The set's signatures in its own class and, as the smaller set of a pair, in the next; and how many it can do without.

    A signature's last bit is that of its class; the two numbers are those of the even and of the odd class.
    """
    classes = _classes.setdefault(percent, Classes(percent))
    n = len(s)
    spare = [0, 0]
    if n == 0:
        return np.zeros(0, np.int64), (0, 0)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s + _GOLD))])
    out = []
    own = classes.of(n)
    for c in (own, own + 1):
        d, k = classes.ranges(c)
        if d == 0:
            continue  # only equal sets link, and those are one member anyway
        step = (1 << 64) // k
        edges = np.arange(1, k, dtype=np.uint64) * np.uint64(step)
        at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
        content = sums[at[1:]] - sums[at[:-1]]
        full = at[1:] > at[:-1]
        where = np.arange(k, dtype=np.uint64) + np.uint64(c << 40)
        sig = _mix(_mix(content + _GOLD) ^ _mix(where + _GOLD))
        sig = sig & ~np.uint64(1) | np.uint64(c & 1)
        empty = int((~full).sum())
        out.append(sig if empty >= k - d else sig[full])
        spare[c & 1] = max(0, k - d - 1 - (0 if empty >= k - d else empty))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), (spare[0], spare[1])


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return int(np.uint64(d >> 64).astype(np.int64)), int(np.uint64(d & (1 << 64) - 1).astype(np.int64))


def describe(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, even, odd, sigs) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                rows, sigs = [], []
                for text in b.column(1).slice(a, 500):
                    s = shingle_hashes(text.as_py(), n)
                    sig, spare = signatures(s, percent)
                    rows.append((len(s), *_keys(s), *spare))
                    sigs.append(sig)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                values = pa.array(np.concatenate(sigs), pa.int64())
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 500), *columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "n", "k1", "k2", "even", "odd", "sigs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, even long, odd long, sigs array<long>")


def shingle_sets(docs: DataFrame, columns: list[str], text_col: str, n: int = N) -> DataFrame:
    """columns and ``set array<long>`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part = b.slice(a, 200)
                sets = [shingle_hashes(t.as_py(), n).view(np.int64) for t in part.column(len(columns))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*columns, "set"])

    schema = docs.select(*columns).schema.add("set", T.ArrayType(T.LongType()))
    return docs.select(*columns, text_col).mapInArrow(run, schema)


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among some sets, as a spanning forest: n-gram incidence rows, intersections by matrix product."""
    m = len(ids)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = counts[column] > 1  # n-grams of one member add nothing to an intersection
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((m, m), np.float32)
    width, total = 2048, int((counts > 1).sum())
    for a in range(0, total, width):  # in slices of n-grams: memory is bounded for sets of any size
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((m, min(width, total - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        inter += part @ part.T
    union = sizes[:, None] + sizes[None, :] - inter
    near = np.triu(100 * inter >= percent * union, 1)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b) links among the members of each key; rows: keys, rep, set."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[int, np.ndarray] = {}
        for chunk in table.to_batches():
            for rep, s in zip(chunk.column("rep"), chunk.column("set"), strict=True):
                seen[rep.as_py()] = s.values.to_numpy(zero_copy_only=False)
        links = spanning_links(np.array(list(seen), np.int64), list(seen.values()), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.select(*keys, "rep", "set").groupBy(*keys).applyInArrow(run, "a long, b long")


def _groups(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, grp): what equal signatures chain together; shared: (k1, sig)."""
    low = scratch.keep(shared.groupBy("sig").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("sig", "low"), "low")
    chained = scratch.keep(shared.join(low, "sig").where("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b")).distinct(), "chained")
    groups = scratch.keep(components(chained, scratch).distinct().select(F.col("node").alias("k1"), F.col("component").alias("grp")), "groups")
    scratch.drop(low, chained)
    return groups


def _passes(table: DataFrame, column: str) -> int:
    """In how many passes to shuffle the items of an array column."""
    items = table.agg(F.sum(F.size(column))).first()[0] or 0
    return min(MOST_PASSES, max(LEAST_PASSES, -(-items // PASS)))


def _pass(items: DataFrame, column: str, i: int, passes: int) -> DataFrame:
    """The i-th part of the items, by bits of a hash that neither a signature's class nor a range has a part in."""
    return items.where(F.pmod(F.shiftright(column, 8), F.lit(passes)) == i)


def similar_groups(described: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, sig) of signatures that different sets share, without those that a set can do without."""
    # Of equal sets one row signs; further rows that the filter lets through are equal to it.
    rows = key_filter(described.select("id", "k1", "even", "odd", "sigs"), "id", classes.select(F.col("rep").alias("id")))
    # In passes, each over some of the signatures: what is shuffled at once, and what the filter's bitmap has to tell apart, stay small.
    passes = _passes(described, "sigs")
    parts = []
    for i in range(passes):
        signed = _pass(rows.select("k1", "even", "odd", F.explode("sigs").alias("sig")), "sig", i, passes)
        # Copies that the filter let through may count twice here; they form no group.
        counted = scratch.keep(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counted")
        parts.append(scratch.keep(key_filter(signed, "sig", counted).join(counted, "sig").distinct(), "met"))
        scratch.drop(counted)
    shared = reduce(DataFrame.union, parts)
    common_first = F.row_number().over(Window.partitionBy("k1", F.col("sig").bitwiseAND(1)).orderBy(F.desc("df"), "sig"))
    spare = F.when(F.col("sig").bitwiseAND(1) == 0, F.col("even")).otherwise(F.col("odd"))
    shared = scratch.keep(shared.select("k1", "sig", (common_first > spare).alias("needed")).where("needed").select("k1", "sig"), "shared")
    scratch.drop(*parts)
    return shared


def _opened(blocks: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    return _links(blocks.join(key_filter(sets.select("rep", "set"), "rep", blocks), "rep"), keys, percent)


def _heads(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(grp, token, rep, n, place): the rarest n-grams of each set, one of which a linked pair of a group has in common.

    A set of n can't link unless ceil(percent * n / 100) of its n-grams are common to both, so the rarest
    common one has no more than the others before it, n-grams in order of their rarity in the group.
    Only n-grams of these members move, in passes.  rest: (grp, rep).
    """
    own = key_filter(sets.select("rep", "set"), "rep", rest).join(rest, "rep")
    own = scratch.keep(own.select("grp", "rep", F.xxhash64("set").alias("same"), F.size("set").cast("long").alias("n"), "set"), "own")
    passes = _passes(own, "set")
    parts = []
    for i in range(passes):
        tokens = _pass(own.select("grp", "rep", "same", "n", F.explode("set").alias("token")), "token", i, passes)
        often = tokens.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        parts.append(scratch.keep(tokens.join(often, ["grp", "token"]), "often"))
    once = Window.partitionBy("rep", "same")
    # N-grams of one member only come first; they have places, but meet none.
    ranked = reduce(DataFrame.union, parts).withColumn("place", F.col("n") - F.count(F.lit(1)).over(once) + F.row_number().over(once.orderBy("df", "token")))
    heads = ranked.where(F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    heads = scratch.keep(heads.select("grp", "token", "rep", "n", "place"), "ranked")
    scratch.drop(own, *parts)
    return heads


def _candidates(heads: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """(a, b) of different components that have one of their heads in common and, by what is after it, may link.

    In a turn, only pairs of one member of each n-gram, another one in each turn, with all others: they
    link most of what are near copies of each other, so that few of their pairs are left.
    """
    x = heads
    if turn is not None:
        x = heads.groupBy("grp", "token").agg(F.min_by(F.struct("rep", "component", "n", "place"), F.xxhash64("rep", F.lit(turn))).alias("hub")).select("grp", "token", "hub.*")
    x, y = x.alias("x"), heads.alias("y")
    least = 1 + F.least(F.expr("x.n - x.place"), F.expr("y.n - y.place"))
    meet = F.expr("x.grp = y.grp AND x.token = y.token AND x.component <> y.component" + (" AND x.rep < y.rep" if turn is None else ""))
    pairs = x.join(y, meet & ((100 + percent) * least >= percent * F.expr("x.n + y.n")))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    described = scratch.keep(describe(docs, id_col, text_col, n, percent), "described")
    all_docs = scratch.keep(described.select("id", "n", "k1", "k2"), "docs")
    classes = scratch.keep(all_docs.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")

    # 1. Groups.
    shared = similar_groups(described, classes.where("rep IS NOT NULL"), scratch)
    scratch.drop(described)
    groups = _groups(shared, scratch)

    # 2. The token-group matrix, and each member's overlap with the rest of its group.
    members = scratch.keep(classes.where("rep IS NOT NULL").join(groups, "k1").select("k1", "rep", "grp"), "members")
    texts = key_filter(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")), "rep", members.select("rep"))
    # Rows that repeat an id: any of them that has the set will do, so a set is kept for each of them.
    sets = scratch.keep(shingle_sets(texts.join(members, "rep").select("rep", "grp", "text"), ["rep", "grp"], "text", n), "sets")
    passes = _passes(sets, "set")
    parts = []
    for i in range(passes):  # the n-grams of some rows of the matrix at a time
        tokens = _pass(sets.select("grp", "rep", F.explode("set").alias("token")), "token", i, passes)
        matrix = tokens.groupBy("grp", "token").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
        only = matrix.where("low = high").groupBy(F.col("low").alias("rep")).agg(F.count(F.lit(1)).alias("alone"))
        parts.append(scratch.keep(only, "alone"))
    alone = reduce(DataFrame.union, parts).groupBy("rep").agg(F.sum("alone").alias("alone"))
    size = sets.select("rep", F.size("set").cast("long").alias("n")).groupBy("rep").agg(F.max("n").alias("n"))
    size = size.join(alone, "rep", "left").withColumn("overlap", F.col("n") - F.coalesce("alone", F.lit(0)))
    left = scratch.keep(members.join(size.where(100 * F.col("overlap") >= percent * F.col("n")), "rep").select("k1", "rep", "overlap"), "left")
    scratch.drop(*parts)
    groups = _groups(shared.join(left.select("k1"), "k1", "left_semi"), scratch)
    scratch.drop(shared)

    # 3. Open the groups that qualify, in blocks with pivots.
    open_ = left.join(groups, "k1").select("grp", "rep", "overlap")
    open_ = scratch.keep(open_.join(open_.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "grp"), "open")
    count = F.ceil(F.col("size") / BLOCK).cast("long")
    blocks = open_.select("grp", F.pmod(F.xxhash64("rep"), count).alias("block"), "rep")
    large = open_.where(F.col("size") > BLOCK)
    pivots = large.groupBy("grp", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(PIVOTS)).alias("p")).agg(F.max_by("rep", F.struct("overlap", "rep")).alias("rep"), F.first("size").alias("size"))
    pivots = pivots.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"), "rep")
    first = scratch.keep(_opened(blocks.union(pivots).distinct(), sets, ["grp", "block"], percent), "links")

    # 4. Members of large groups that are in different components and may link.
    links, rest = first, large.select("grp", "rep")
    if not rest.isEmpty():
        heads = scratch.keep(_heads(scratch.keep(rest, "rest"), sets, percent, scratch), "heads")
        for i in range(ROUNDS + 1):
            found = scratch.keep(components(links, scratch).distinct(), "found")
            labelled = scratch.keep(heads.join(found, F.col("rep") == F.col("node"), "left").select(*heads.columns, F.coalesce("component", "rep").alias("component")), "labelled")
            pairs = scratch.keep(_candidates(labelled, percent, i if i < ROUNDS else None), "pairs")
            parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("a")) / BLOCK).cast("long")
            dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
            more = _opened(dealt.select("a", "part", F.explode(F.array("a", "b")).alias("rep")).distinct(), sets, ["a", "part"], percent)
            links = scratch.keep(links.union(more), "links")
            scratch.drop(found, labelled, pairs)
    linked = scratch.keep(components(links, scratch).distinct(), "linked")
    scratch.drop(sets)

    reps = scratch.keep(classes.join(linked, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component")), "reps")
    out = all_docs.join(reps, ["k1", "k2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id, with the input's columns."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.keep(ngram_components(docs, id_col, text_col, n, percent).select("id", "component_id"), "found")
    stays = F.col("id").isNull() | (F.col("id") == F.col("component_id"))
    mine = docs.select(as_row(docs).alias("row"), docs[quoted(id_col)].cast("long").alias("id"))
    sure, others = told(mine, "id", found.select("id", stays.cast("int").alias("n")))
    # An anti-join would be moved below the choice of rows, and shuffle all of them.
    others = others.join(found.where(~stays).select("id").distinct().withColumn("_go", F.lit(True)), "id", "left").where("_go IS NULL")
    return sure.select("row.*").union(others.select("row.*"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_components(documents(spark, sf_dir), n=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
