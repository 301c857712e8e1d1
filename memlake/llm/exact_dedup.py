"""Exact dedup against a persistent digest index (operator 6), in DataFrame operations only.

The index is a table bucketed and sorted by digest.  A batch of documents is reduced to digests, its
distinct digests are sort-merge anti-joined with the index, and those that are new are appended under
the batch's name.  A whole table goes through the index in a few batches in the order of its ids.

Recovery: the caller names a batch.  A batch that is added again, after a crash at any point, is held
against the other batches only and appends what its first run didn't, so it gets the same decisions.
Each append adds a file to every bucket; ``compact`` rewrites the index with one sorted file a bucket.

Defined results: a null text counts as empty; texts of any length are hashed whole; texts are equal
when identical after each run of ASCII white space became one space; of equal texts the row with the
smallest id stays (a null id comes last), if batches come in the order of ids, else that of the
earlier batch; rows that repeat an id and its text are one document and all report the same decision;
an empty batch gives no rows and leaves the index as it was; further columns are ignored by the index
and passed through by ``drop_copies`` whatever their names.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import WS, Scratch, _delete, as_row, documents, quoted, shared_dir, told

SCHEMA = "digest binary, keep_id {id}, batch string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, batch), bucketed and sorted by digest.

    The number of buckets is fixed when the index is made; size it so that a bucket of the full
    index sorts in an executor's memory (1 TB of digests: some 16,000).
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.name, self.buckets = spark, name, buckets
        self._fresh = f"{name}_compacted"
        exists = spark.catalog.tableExists
        if not exists(name) and exists(self._fresh):  # a compaction that ended between its last two steps
            spark.sql(f"ALTER TABLE {self._fresh} RENAME TO {name}")
        if not exists(name):
            columns = SCHEMA.format(id=id_type)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self._place()}'")

    def _place(self) -> str:
        """A folder for a table among those that all executors share, wherever the session's warehouse is."""
        return f"{shared_dir(self.spark)}/memlake/tables/{uuid.uuid4().hex}"

    def _remove(self, name: str) -> None:
        """Drop a table with its files, if there is one."""
        if self.spark.catalog.tableExists(name):
            where = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            _delete(self.spark, where)

    def _write(self, rows: DataFrame, name: str, place: str | None = None) -> None:
        # Dealt by the number of the bucket, so that an append makes one file for each, however many tasks there are.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        out = rows.repartition(self.buckets, bucket).write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (out.option("path", place) if place else out).saveAsTable(name)

    def known(self) -> DataFrame:
        return self.spark.table(self.name).hint("merge")

    def append(self, seen: DataFrame, batch: str) -> None:
        """Add the digests of (id, digest) rows that the index doesn't know from other batches."""
        first = seen.groupBy("digest").agg(F.min("id").alias("keep_id")).withColumn("batch", F.lit(batch))
        self._write(first.join(self.known().select("digest"), "digest", "left_anti"), self.name)

    def decide(self, seen: DataFrame, batches: list[str], scratch: Scratch) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) for (id, digest) rows of these batches."""
        groups = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        # One row for each text, written out so that both sides of the next join are plain exchanges:
        # Spark can then split a text that a third of all rows share.
        verdict = groups.join(self.known(), "digest").select("digest", "keep_id", "group_size", F.col("batch").isin(batches).alias("fresh"))
        out = seen.join(scratch.keep(verdict, "verdict"), "digest")
        return out.select("id", "digest", "keep_id", "group_size", (F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> DataFrame:
        """Decide on a batch and append its new digests, in parts by order of id.

        Returns (id, digest, keep_id, group_size, kept) for each row of the batch; keep_id is the id
        that the index holds for the text, group_size counts the batch's rows with it.
        """
        scratch = Scratch(self.spark, "exact-dedup")
        seen = scratch.keep(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "seen")
        names = [f"{batch}/{i}" for i in range(parts)]
        share = [i / parts for i in range(1, parts)]
        cuts = [*(seen.agg(F.percentile_approx("id", share)).first()[0] or []), None] if share else [None]
        low = None
        for name, cut in zip(names, cuts, strict=False):
            above = F.lit(True) if low is None else F.coalesce(F.col("id") > low, F.lit(True))
            self.append(seen.where(above if cut is None else above & (F.col("id") <= cut)), name)
            low = cut
        return self.decide(seen, names, scratch)

    def compact(self) -> None:
        """Rewrite the index with one sorted file for each bucket; safe to repeat after a crash."""
        self._remove(self._fresh)
        self._write(self.spark.table(self.name), self._fresh, self._place())
        self._remove(self.name)
        self.spark.sql(f"ALTER TABLE {self._fresh} RENAME TO {self.name}")

    def drop(self) -> None:
        self._remove(self.name)


#: Parts in which a whole table goes through a new index.
PARTS = 2


def temporary_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An index of its own for a one-off run; dropped when the driver ends."""
    index = DigestIndex(spark, f"memlake_digests_{uuid.uuid4().hex}", buckets)

    def gone() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                index.drop()
        except Exception:  # the session has ended
            return

    atexit.register(gone)
    return index


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str = "all", id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """The documents that stay, with the input's columns; of rows repeating id and text, one."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    decided = scratch.keep(index.add(docs, batch, id_col, text_col, parts).select("id", "digest", "kept"), "decided")
    # Where one row has an id, the id settles it and the text stays where it is.
    by_id = decided.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("kept").cast("int")).alias("n"))
    # The operator's own columns are beside the row, a struct, so no name of the input can clash with them.
    mine = docs.select(as_row(docs).alias("row"), docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].alias("text"))
    sure, others = told(mine, "id", scratch.keep(by_id, "by_id"))
    stay = decided.where("kept").select("id", "digest").distinct()
    keyed = others.select("row", F.struct("id", digest(F.col("text")).alias("digest")).alias("key"))
    # A semi-join would be moved below the choice of rows, and shuffle all of them.
    once = keyed.join(stay, keyed["key.id"].eqNullSafe(stay["id"]) & (keyed["key.digest"] == stay["digest"])).dropDuplicates(["key"])
    return sure.select("row.*").union(once.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = temporary_index(spark).add(documents(spark, sf_dir), "documents", parts=PARTS)
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
