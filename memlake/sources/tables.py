"""Readers: the tables of a folder, and the views that map them onto the memory model.

Every view exists twice, as a DataFrame and as SQL text (``VIEW_SQL``), by the same rule; queries are
checked against the SQL in another engine.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The time that scores refer to; a parameter everywhere, never the clock.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEW_SQL = {
    "memories": """
SELECT v.vec_id AS id, e.user_id % 20 AS user_id, d.text AS content, v.embedding AS embedding,
  least(1.0, e.value / 100.0) AS importance, d.source AS source_site, d.lang || '/' || d.source AS namespace,
  v.vec_id % 30 AS episode_id, CASE WHEN v.vec_id % 17 = 3 THEN 'archived' ELSE 'active' END AS status,
  CASE WHEN v.vec_id % 19 = 5 THEN e.ts END AS expired_at, CASE WHEN v.vec_id % 23 = 7 THEN e.ts END AS deleted_at,
  CASE WHEN v.vec_id % 5 = 0 THEN 'w' || (v.vec_id % 2) END AS workspace_id,
  CASE WHEN v.vec_id % 4 > 0 THEN 'a' || (v.vec_id % 4) END AS agent_id,
  CASE v.vec_id % 3 WHEN 0 THEN 'workspace' WHEN 1 THEN 'agent_only' ELSE 'restricted' END AS visibility,
  0.5 + (v.vec_id % 6) / 10.0 AS trust, e.ts AS created_at, e.ts AS last_accessed_at, v.vec_id % 12 AS access_count,
  CASE WHEN v.vec_id % 7 < 5 THEN 'k' || (v.vec_id % 7) END AS state_key, v.label AS topic, e.event_type AS memory_type
FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id JOIN events e ON e.event_id = v.vec_id""",
    "episodes": "SELECT conv_id AS episode_id, 's' || (conv_id % 9) AS session_id, min(turn) AS first_turn, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "versions": """
SELECT event_id AS version_id, user_id % 50 || ':' || event_type AS claim_id, user_id % 50 AS user_id, event_type AS slot, value AS confidence,
  props AS content, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(event_id) OVER w AS superseded_by, lag(event_id) OVER w AS previous_version,
  CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'supersede' ELSE 'delete' END AS mutation_type
FROM events WINDOW w AS (PARTITION BY user_id % 50, event_type ORDER BY ts, event_id)""",
    "part_edges": """
SELECT a.l_partkey AS entity_a, b.l_partkey AS entity_b, min(a.l_orderkey) AS memory_id, count(*) AS n
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey""",
    "relations": "SELECT 'c' || c_custkey AS source_entity, 'n' || c_nationkey AS target_entity, 'located_in' AS relation_type, least(1.0, abs(c_acctbal) / 10000.0) AS confidence, CASE WHEN c_custkey % 10 = 0 THEN 1 END AS closed FROM customer",
    "attributes": """
SELECT doc_id AS fact_id, 'src' || (doc_id % 20) AS entity, a.attribute AS attribute, CASE a.attribute WHEN 'quality' THEN quality ELSE toxic END AS value, doc_id AS observed_at
FROM labels CROSS JOIN (SELECT 'quality' AS attribute UNION ALL SELECT 'toxic') a""",
}


def with_views(body: str, *names: str) -> str:
    """SQL in which the views of ``names`` stand; body is a query or starts with further CTEs after a comma."""
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes} {body}"


#: Lines of orders in one task of what joins them with each other.
LINES = 250_000


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the lines and their pairs: they grow with the table, so that a task's rows don't. A count reads footers only."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey), dealt by order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(line_parts(spark, sf_dir), "l_orderkey")


def by_edge(pairs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.repartition(line_parts(spark, sf_dir), "entity_a", "entity_b")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of that name. Pairs hardly repeat, so they are dealt as they are and counted where they arrive."""
    x = part_lines(spark, sf_dir)
    a = x.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_a"))
    b = x.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_b"))
    pairs = by_edge(a.join(b, "memory_id").where("entity_a < entity_b"), spark, sf_dir)
    return pairs.groupBy("entity_a", "entity_b").agg(F.min("memory_id").alias("memory_id"), F.count(F.lit(1)).alias("n"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame.  The SQL text is Spark SQL as well; Catalyst prunes what a query doesn't use."""
    if name == "part_edges":
        return part_edges(spark, sf_dir)
    text = VIEW_SQL[name]
    frames = {t: table(spark, sf_dir, t) for t in ("embeddings", "documents", "events", "conversations", "lineitem", "customer", "labels") if t in text}
    named = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], text)
    return spark.sql(named, **frames)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="memlake-"))
    return _own[0]


_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that its lineage ends."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Kept:
    """Tables of one operator in the shared folder, which it drops as soon as nothing reads them.

    The shuffle files of the step that wrote a table go with the step; what is left goes when the driver ends.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/memlake-kept/{uuid.uuid4().hex}", {}
        atexit.register(self._end)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.select("*").write.parquet(path)  # planned anew under that setting
        finally:
            self.spark.conf.unset(self.CLEAN) if before is None else self.spark.conf.set(self.CLEAN, before)
        out = parquet_with_schema(self.spark, path, df.schema)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            self._delete(path)
            self.paths[path] = None

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended
            return


def parquet_with_schema(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_wiki_export(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki export (one JSON object with ``pages``), read with a declared schema; one row a page."""
    schema = "exportedAt string, pageCount int, projectId string, pages array<struct<title:string,slug:string,summary:string,sources:array<string>,tags:array<string>,links:array<string>,body:string,kind:string,aliases:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("exportedAt", "projectId", "pageCount", F.explode("pages").alias("p")).select("exportedAt", "projectId", "pageCount", "p.*")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Raw blobs by path, with their SHA-256."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Trace, audit and cost records as JSON lines."""
    df.write.mode("append").json(path)
