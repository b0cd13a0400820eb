"""Query of the embedding whitening."""

from __future__ import annotations

from devicehealth.llm.registry import query, table
from devicehealth.llm.whitening import whitened


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
