"""Query of the packing."""

from __future__ import annotations

import public_tokenizers

from devicehealth.llm.packing import packed_documents
from devicehealth.llm.registry import query, table


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
