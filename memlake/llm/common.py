"""Shared plumbing of the training-data operators: input tables, scratch tables, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class shared by several contracts.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

_own_dir: str | None = None
_scratch: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*[df[quoted(c)].alias(c) for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="memlake-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables an operator writes to the shared folder to cut lineage and to compute a thing once.

    A table is an ordinary committed Parquet folder, so it survives the loss of any executor.
    The shuffle files of the step that wrote it go at once, as nothing else reads them.
    drop() removes a table as soon as nothing reads it; the rest goes when the driver ends.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/memlake/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _scratch.append((spark, self.root))

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            # Planned anew under that setting; df itself may have been made before.
            df.select("*").write.parquet(path)
        finally:
            self.spark.conf.unset(self.CLEAN) if before is None else self.spark.conf.set(self.CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._memlake_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_memlake_path", None):
                _delete(self.spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; its cluster clears the shared folder
            return


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, also where body is used inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 256


def blocks(array: Column) -> Column:
    """An array cut into arrays of at most BLOCK items, so that work that is quadratic in a block stays bounded."""
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    return let(array, cut)


#: Bits of a key filter.
FILTER_BITS = 1 << 26


def key_filter(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose 64-bit key may be among the wanted ones: all that are, and some others.

    A bitmap over the keys' remainders, 8 MB at any size of the input, is broadcast; where it fills up
    it merely lets more rows pass.  Callers join the result exactly.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("_p")).select(F.bitmap_bucket_number("_p").alias("_row"), F.bitmap_bit_position("_p").alias("_bit"))
    # Dealt by row first: partial bitmaps of each task would be as large as the whole.
    bits = bits.repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    keyed = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_row"))
    return keyed.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def told(rows: DataFrame, key: str, verdicts: DataFrame, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """How often each row stays, without moving it: (rows that stay with the column ``_n``, rows that a join must decide).

    verdicts: (key, n) for every key, n from 0 to ``most``, or null where the key doesn't settle it.  Keys
    share the places of a few bitmaps, 8 MB each at any size of the input, which are broadcast; a place
    is settled if all its keys have one n.  Rows of other places, hardly any until bitmaps fill up, are
    the second table, which callers join exactly.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    open_ = most + 1
    code = F.when((F.min("n") == F.max("n")) & (F.count("n") == F.count(F.lit(1))), F.min("n")).otherwise(open_).cast("int")
    places = verdicts.select(place.alias("_p"), "n").groupBy("_p").agg(code.alias("_code")).where("_code > 0")
    planes = range(open_.bit_length())
    bits = places.select(F.bitmap_bucket_number("_p").alias("_row"), F.bitmap_bit_position("_p").alias("_bit"), "_code").repartition("_row").groupBy("_row")
    bits = bits.agg(*[F.bitmap_construct_agg(F.when(F.getbit("_code", F.lit(i)) == 1, F.col("_bit"))).alias(f"_bits{i}") for i in planes])
    at = F.bitmap_bit_position(place)
    byte = lambda i: F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    n = sum((F.getbit(byte(i), (at % 8).cast("int")).cast("int") * (1 << i) for i in planes), F.lit(0))
    keyed = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_row")).select(*map(quoted, rows.columns), n.alias("_n"))
    return keyed.where((F.col("_n") > 0) & (F.col("_n") < open_)), keyed.where(F.col("_n") == open_).drop("_n")


def apart_blocks(rows: DataFrame, group: str, item: str, scratch: Scratch, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What to compare so that all items of a group meet that are in different components.

    rows: (group, item, component, ...).  Components of half a block or more have blocks of their own,
    which need not meet each other; all other components of a group share blocks.  Returns rows with
    their block (big, only, part) and pairs of blocks (group, p, q), structs of the same, p = q for a
    shared block with itself.  Blocks hold some ``size`` items, so a pair of them is bounded work; there
    are as many pairs as unlinked items call for, none within one component.
    """
    parts = lambda n: F.ceil(F.col(n) / size).cast("long")
    per = scratch.keep(rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n")), "per")
    big = per.where(F.col("n") >= size // 2).select(group, "component", parts("n").alias("parts"))
    shared = per.where(F.col("n") < size // 2).groupBy(group).agg(F.sum("n").alias("n")).select(group, parts("n").alias("shared"))
    tagged = rows.join(big, [group, "component"], "left").join(shared, group, "left").withColumn("big", F.col("parts").isNotNull())
    part = F.when(F.col("big"), F.pmod(F.xxhash64(item), F.col("parts"))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    tagged = tagged.select(*rows.columns, "big", F.when(F.col("big"), F.col("component")).otherwise(0).alias("only"), part.alias("part"))
    block = lambda b, only, part: F.struct(F.lit(b).alias("big"), F.col(only).alias("only") if only else F.lit(0).cast("long").alias("only"), F.col(part).alias("part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    each = shared.select(group, "shared", upto("shared").alias("i"))
    within = each.select(group, "i", F.explode(F.sequence("i", F.col("shared") - 1)).alias("k")).select(group, block(False, None, "i").alias("p"), block(False, None, "k").alias("q"))
    between = each.join(big, group).select(group, "i", "component", upto("parts").alias("k")).select(group, block(False, None, "i").alias("p"), block(True, "component", "k").alias("q"))
    other = big.select(group, F.col("component").alias("other"), F.col("parts").alias("parts_o"))
    large = big.join(other, group).where("component < other").select(group, "component", "other", "parts_o", upto("parts").alias("i"))
    large = large.select(group, "component", "other", "i", upto("parts_o").alias("k")).select(group, block(True, "component", "i").alias("p"), block(True, "other", "k").alias("q"))
    return tagged, within.union(between).union(large)


_shipped: set[str] = set()

#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers import it; keep their batches small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="memlake-ship-")
    path = os.path.join(folder, "memlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(package):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of (a, b) edges by alternating large-star and small-star steps.

    Returns (node, component), component being the smallest node of the component, for every node
    that has an edge.  Each step is two narrow joins of the edge table with one minimum per node, so
    no neighbour list is ever gathered in a task and a star centre of any degree is fine: its minimum
    is pre-aggregated and Spark may split its side of the join.  Steps are cut by written tables.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.keep(e, "edges")
    state = None
    while True:
        # Large star: link every larger neighbour of u to the smallest node around u.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.keep(large.distinct(), "large")
        # Small star: link u and its smaller neighbours to the smallest of them.
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = scratch.keep(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(e, low, large, low2)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
