"""Query of the near-duplicate vectors."""

from __future__ import annotations

from devicehealth.llm.near_vectors import near_vectors
from devicehealth.llm.registry import query, table


@query("op1_embedding_near_dedup")
def op1_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
