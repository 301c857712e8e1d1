import os
import random

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes (doc_id, text, lang, source) rows as a documents table with further, clashing columns."""

    def write(rows, schema="doc_id long, text string, lang string, source string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long"))
        for c in ("id", "key", "size", "score", "kept", "row", "grp", "set", "digest", "line", "n", "a.b"):
            df = df.withColumn(c, F.lit("clash"))
        n = len(os.listdir(tmp_path))
        df.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        return f"{tmp_path}/{n}"

    return write


@pytest.fixture
def words():
    r = random.Random(11)
    return lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
