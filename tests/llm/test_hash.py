"""Two long strings over two letters, one the other with its letters exchanged: sums of powers cannot tell them apart."""

import public_tokenizers
from tokenizers import Tokenizer

from devicehealth.llm.bpe import encode
from devicehealth.llm.near_text import near_duplicates
from devicehealth.llm.packing import packed_documents
from devicehealth.llm.token_counts import token_counts
from test_tokens import check_packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def pair(n, letters):
    first = "".join(letters[i.bit_count() % 2] for i in range(n))
    return first, first.translate(str.maketrans(letters, letters[::-1]))


TEXTS = [*pair(2048, "tz"), *pair(1024, "ab"), *pair(4096, "éß")]


def test_counts_and_ids(spark):
    tk = Tokenizer.from_file(WORD)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    want = {i: tk.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids for r in encode(docs, WORD).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, WORD).collect()} == {i: len(ids) for i, ids in want.items()}


def test_packing(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    check_packing(packed_documents(docs, BYTE, 1024).collect(), dict(enumerate(TEXTS)), 1024)


def test_near_duplicates(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    assert all(r.kept for r in near_duplicates(docs).collect())
