"""Merkle dataset manifest (operator 11), in DataFrame operations only.

Each row is a leaf: the digest of its fields.  The leaves of a group, in order of their id, are nodes
of level 0; a window over (group, parent index) with a full frame gathers the ordered nodes of a run,
which is both the parent's preimage and, without the node itself, its siblings; one row of each run
goes up to the next level, until every group has a single node.  Those nodes, in order of their group,
are the leaves of a second tree of the same kind, whose last node is the root of the dataset.

A proof is the path from a leaf to the root: on each level the digests left of the node and right of it.
Folding a path from any leaf gives the root that this leaf would lead to.

Scale: texts are read once and never shuffled; a row is its keys and two digests from then on.  Rows are
range-partitioned by (group, id, leaf) and numbered by the engine within partitions, so that a group
with a third of all rows is spread over many tasks and its order needs no window of its own; the table
of (group, partition) counts turns that into places.  A window holds at most ``FANOUT`` rows.  Level k
has 1/16 of the rows of the level below, and there are log16 of the largest group's rows many.  A path
is joined to a row at the very end, on the key of the window before it, so paths of leaves (a few
kilobytes each) aren't shuffled; those of parents are a sixteenth as many.

Defined results: a null field is ``-``; an empty text is ``0:``; a null group is a group of its own,
before all others; a group of one row has its leaf as subroot and no step of its own; a null id comes
first in its group; rows with equal ids are leaves of their own, in order of their digests; equal rows
are separate leaves too; an empty table has no rows, no levels and no root; further columns are neither
hashed nor read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import Scratch, documents

#: Children of a node.
FANOUT = 16
#: The hashed fields of a document, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (grp, ...) with idx, their place in their group by ``order``, and n, the group's size; written to a table.

    The engine's own row number within a range partition is a row's place there; places of a group
    in earlier partitions are summed up from one row for each (group, partition).
    """
    keys = ["grp", *order]
    # Equal rows are told apart by where they were read, so that a third of equal rows is many ranges too.
    spread = rows.withColumn("_read", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, "_read").sortWithinPartitions(*keys, "_read").drop("_read")
    sorted_rows = scratch.keep(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sorted")
    parts = sorted_rows.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    parts = parts.select("grp", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    placed = sorted_rows.join(scratch.keep(parts, "parts"), ["grp", "_part"])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "n")


def _run(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, node, n, ...) of unfinished groups with parent, their parent's index, and run, the nodes of their run in order."""
    w = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = nodes.where("n > 1").withColumn("parent", F.floor(F.col("idx") / FANOUT).cast("long"))
    return open_.withColumn("run", F.collect_list("node").over(w))


def levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (grp, idx, node, n) from level 0 (the nodes given) upwards; a group ends where its n is 1."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        first = _run(out[-1].select("grp", "idx", "node", "n")).where(F.col("idx") % FANOUT == 0)
        up = first.select("grp", F.col("parent").alias("idx"), F.sha2(F.array_join("run", "").cast("binary"), 256).alias("node"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        out.append(scratch.keep(up, "level"))
        most = -(-most // FANOUT)
    return out


def paths(tree: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of level 0 with path, their steps to the root, and the further columns of ``above``.

    above: (grp, path, ...) for each group, the steps from its last node on.
    """
    extra = [c for c in above.columns if c not in ("grp", "path")]
    out = None
    for k in range(len(tree) - 1, -1, -1):
        nodes = tree[k]
        done = nodes.where("n = 1").join(above, "grp")
        if out is None:
            out = done
        else:
            at = (F.col("idx") % FANOUT).cast("int")
            own = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(FANOUT)), "").alias("right"))
            upper = out.select("grp", F.col("idx").alias("parent"), F.col("path").alias("upper"), *extra)
            step = _run(nodes).join(upper, ["grp", "parent"]).withColumn("path", F.concat(F.array(own), "upper"))
            out = step.select(*nodes.columns, "path", *extra).union(done.select(*nodes.columns, "path", *extra))
        out = out if k == 0 else scratch.keep(out, "paths")
    return out


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, node, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A key that is never null; in byte order null comes first."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, also: Callable[[], dict[str, Column]] = dict,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, proofs) of a table.

    nodes: (tree, level, grp, idx, node, n), every node of the groups' trees ("group") and of the tree
    over their last nodes ("root"): the manifest to keep.  proofs: for each row (id, idx, n, node, path,
    subroot, root) and the columns named by ``also``, computed from the row where its fields are read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    quoted = lambda c: F.col(f"`{c}`")
    rows = docs.select(group_key(quoted(group_col)).alias("grp"), quoted(id_col).alias("id"), leaf(*map(quoted, fields)).alias("node"), *[c.alias(n) for n, c in also().items()])
    # Written first, as finding the ranges reads the rows twice.
    groups = levels(ranked(scratch.keep(rows, "leaves"), ["id", "node"], scratch), scratch)

    one = None  # the last node of each group
    for nodes in groups:
        last = nodes.where("n = 1").select("grp", "node")
        one = last if one is None else one.union(last)
    tops = ranked(one.select(F.lit("r").alias("grp"), F.col("grp").alias("key"), "node"), ["key"], scratch)
    roots = levels(tops, scratch)
    root = roots[-1].where("n = 1").select("grp", F.array().cast(STEP).alias("path"), F.col("node").alias("root"))
    above = paths(roots, root, scratch).select(F.col("key").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    proofs = paths(groups, scratch.keep(above, "above"), scratch).drop("grp")

    nodes = None
    for tree, tables in (("group", groups), ("root", roots)):
        for k, t in enumerate(tables):
            part = t.select(F.lit(tree).alias("tree"), F.lit(k).alias("level"), "grp", "idx", "node", "n")
            nodes = part if nodes is None else nodes.union(part)
    return nodes, proofs


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups whose subroots differ between the nodes of two manifests, or that only one has: (grp, old, new)."""
    top = lambda t, name: t.where("tree = 'group' AND n = 1").select("grp", F.col("node").alias(name))
    both = top(old, "old").join(top(new, "new"), "grp", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered() -> dict[str, Column]:
        low = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
        return {"shown": F.when(hit, leaf(*low)).otherwise(leaf(*map(F.col, FIELDS)))}

    _, proofs = manifest(documents(spark, sf_dir), also=tampered)
    out = proofs.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(group_levels: int = 6, root_levels: int = 3) -> str:
    """The same in SQL, for groups of at most 16^6 rows and 16^3 groups: one step for each level, as wide as the table."""
    f = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    h = lambda text: "sha256(" + " || ".join(f(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('s' || source, 'n') AS grp, {h('text')} AS node, {h(low)} AS lowered FROM documents)",
        "g0 AS (SELECT doc_id, grp, node, lowered, row_number() OVER (PARTITION BY grp ORDER BY doc_id, node) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d)",
    ]

    def tree(name: str, count: int) -> None:
        for k in range(count):
            ctes.append(
                f"{name}r{k} AS (SELECT grp, idx // 16 AS idx, list(node ORDER BY idx) AS run, max(n) AS n FROM {name}{k} GROUP BY grp, idx // 16)"
            )
            ctes.append(f"{name}{k + 1} AS (SELECT grp, idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node, (n + 15) // 16 AS n FROM {name}r{k})")

    tree("g", group_levels)
    ctes.append(f"t0 AS (SELECT grp AS key, 'r' AS grp, node, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM g{group_levels})")
    tree("t", root_levels)
    # CRC-32 of the id's digits: each byte is xored in, then eight shifts follow, marked by -1.
    bits = "list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    ctes.append(f"c AS (SELECT *, coalesce(xor({bits}, 4294967295) % 5 = 0, false) AS hit FROM g0)")
    ctes.append("p0 AS (SELECT c.doc_id, c.grp, c.node AS leaf, c.idx, t0.idx AS place, t0.node AS subroot, CASE WHEN hit THEN lowered ELSE c.node END AS shown, '' AS proof FROM c JOIN t0 ON c.grp = t0.key)")
    made = 0
    for name, place, count in (("g", "idx", group_levels), ("t", "place", root_levels)):
        for k in range(count):
            at = f"(p.{place} // {16**k}) % 16"
            on = f"r.idx = p.{place} // {16 ** (k + 1)}" + (" AND r.grp = p.grp" if name == "g" else "")
            ctes.append(f"q{made} AS (SELECT p.*, r.n, array_to_string(run[1:{at}], '') AS l, array_to_string(run[{at} + 2:], '') AS r FROM p{made} p JOIN {name}r{k} r ON {on})")
            ctes.append(f"p{made + 1} AS (SELECT * EXCLUDE (n, l, r, shown, proof), CASE WHEN n = 1 THEN shown ELSE sha256(l || shown || r) END AS shown, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof FROM q{made})")
            made += 1
    out = f"SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM p{made}, (SELECT node AS root FROM t{root_levels})"
    return "WITH " + ",\n".join(ctes) + "\n" + out


OP11_SQL = _sql()
