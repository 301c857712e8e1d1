"""Wiki pages as inputs for ingest: external ids, provenance and metadata, page by page.

Defined results: a page whose slug, directory or project id isn't allowed, or whose (directory, slug) another
page has too, is refused, all pages of it; a null body is an empty one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTORIES = ("concepts", "queries")
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
VERSION, TRUST = 1, "external-import"


def ingest_inputs(pages: DataFrame, project: str, user: str, prefix: str = "wiki") -> tuple[DataFrame, DataFrame]:
    """(inputs, refused): (external_id, mode, user_id, content, source, extractor, metadata), and pages with the reason.

    pages: (directory, slug, path, title, summary, tags, body).
    """
    allowed = F.coalesce(F.col("directory").isin(*DIRECTORIES) & F.col("slug").rlike(SLUG) & F.lit(project).rlike(SLUG), F.lit(False))
    twice = pages.groupBy("directory", "slug").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("directory", "slug", F.lit(True).alias("_twice"))
    marked = pages.join(twice, ["directory", "slug"], "left").withColumn("reason", F.when(~allowed, "not allowed").when(F.col("_twice"), "duplicate"))
    about = F.struct(
        F.lit(VERSION).alias("version"), F.lit(TRUST).alias("trustLevel"), F.lit(project).alias("projectId"), "path", F.col("directory").alias("pageDirectory"), "slug", "title", "summary", "tags",
    )
    key = F.concat_ws("/", F.lit(prefix), F.lit(project), "directory", "slug")
    inputs = marked.where("reason IS NULL").select(
        key.alias("external_id"), F.lit("verbatim").alias("mode"), F.lit(user).alias("user_id"), F.coalesce("body", F.lit("")).alias("content"), F.lit(prefix).alias("source"), F.lit(prefix).alias("extractor"),
        F.to_json(F.struct(key.alias("externalId"), about.alias(prefix)), {"ignoreNullFields": "false"}).alias("metadata"),
    )
    return inputs, marked.where("reason IS NOT NULL").drop("_twice")
