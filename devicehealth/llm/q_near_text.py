"""Query of the near-duplicate texts."""

from __future__ import annotations

from devicehealth.llm.near_text import near_duplicates
from devicehealth.llm.registry import query, table


@query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)
