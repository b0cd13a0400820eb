"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.registry import query, table
from devicehealth.llm.toxicity import scored, train


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(part != 0))
    return scored(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), F.col("__dh_score").alias("score"),
                                      (F.col("__dh_score") >= 0.5).cast("int").alias("predicted"))
