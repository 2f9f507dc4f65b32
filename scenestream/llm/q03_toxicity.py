"""Query op3: toxicity of every document, learnt from labels outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query
from .toxicity import fit, score


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    found = score(docs, model)
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_passages").cast("long").alias("n_passages"),
    )
