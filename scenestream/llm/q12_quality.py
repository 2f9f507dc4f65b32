"""Query op12: quality of every document, learnt from labels outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import fit, score
from .registry import query


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    found = score(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"),
        F.size("passage_weights").cast("long").alias("n_passages"),
    )
