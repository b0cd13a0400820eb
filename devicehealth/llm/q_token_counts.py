"""Query of the token counts."""

from __future__ import annotations

import public_tokenizers

from devicehealth.llm.registry import query, table
from devicehealth.llm.token_counts import token_counts


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
