"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.langid import predict, train
from devicehealth.llm.registry import query, table


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = train(docs.where(part != 2))
    return predict(docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out")), model).drop("text")
