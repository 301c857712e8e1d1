"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import exact_dedup, infill, language_id, licenses, line_dedup, media, merkle, mixing, ngram_join, packing, pii, sentencepieces, suffix_dedup
from memlake.llm.common import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query ships the package first, so that Python workers import it wherever the driver was started."""
    plain = {
        "op1_mixing": mixing.op1_mixing,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_language_id": language_id.op3_language_id,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_sentencepiece": sentencepieces.op5_sentencepiece,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_pii": pii.op9_pii,
        "op10_media": media.op10_media,
        "op11_merkle": merkle.op11_merkle,
        "op12_packing": packing.op12_packing,
        "op13_infill": infill.op13_infill,
    }
    return {name: _shipped(f) for name, f in plain.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op11_merkle": merkle.OP11_SQL, "op13_infill": infill.OP13_SQL}
