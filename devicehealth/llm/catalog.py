"""All registered queries of the subpackage."""

from __future__ import annotations

from devicehealth.llm import (q_bpe, q_chat, q_filter_audit, q_langid, q_near_text, q_near_vectors, q_packing, q_quality, q_repeats, q_secrets, q_token_counts, q_whitening,  # noqa: F401
                              q_toxicity)  # noqa: F401
from devicehealth.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
