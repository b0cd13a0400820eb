"""Query of the repeated byte strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.registry import query, table
from devicehealth.llm.repeats import repeated_spans


@query("op11_suffix_array_dedup")
def op11_suffix_array_dedup(spark, sf_dir):
    found = repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
