"""Query of BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers

from devicehealth.llm.bpe import encode
from devicehealth.llm.registry import query, table


@query("op5_bpe_encoding")
def op5_bpe_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
