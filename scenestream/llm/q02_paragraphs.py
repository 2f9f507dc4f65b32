"""Query op2: paragraphs that repeat, exactly or nearly, and where each is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .paragraphs import repeated
from .registry import query


@query("op2_paragraphs")
def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", "n_repeated", "n_removed", "kept_in")
