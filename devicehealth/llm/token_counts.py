"""Token counts with a whole-token shortcut: pieces that are proven to be one token are counted, the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays, pretoken
from devicehealth.llm.merges import Store, Vocabulary, file_text, vocabulary

#: Bytes of text split at once.
CHUNK_BYTES = 1 << 20


def proven_keys(vocab: Vocabulary) -> np.ndarray:
    """Sorted keys of the vocabulary's whole words that their own merges lead to: each is one token wherever it is a piece."""
    words, ids = [], []
    for token, number in vocab.ids.items():
        if token.endswith(vocab.end) and len(token) > len(vocab.end):
            words.append(bytes(vocab.bytes[c] for c in token[:len(token) - len(vocab.end)]))
            ids.append(number)
    values, offsets = vocab.encode(words)
    alone = np.flatnonzero(np.diff(offsets) == 1)
    keys = []
    for i in alone[values[offsets[alone]] == np.array(ids)[alone]].tolist():
        try:
            units = np.frombuffer(words[i].decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            continue
        keys.append(arrays.spans_hash(units, np.array([0]), np.array([len(units)])))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _worker(text: str):
    vocab = vocabulary(text)
    return vocab.splitter(), Store(vocab.encode, vocab.special)


def piece_counts(pieces: pretoken.Pieces, proven: np.ndarray, store: Store) -> np.ndarray:
    """Tokens of each piece."""
    keys, at, back = np.unique(pieces.keys, return_index=True, return_inverse=True)
    count = np.ones(len(keys), np.int64)
    if len(proven):
        rest = np.flatnonzero(proven[np.minimum(np.searchsorted(proven, keys), len(proven) - 1)] != keys)
    else:
        rest = np.arange(len(keys))
    if len(rest):
        rows = store.places(keys[rest], pieces, at[rest])
        count[rest] = store.offsets[rows + 1] - store.offsets[rows]
    return count[back]


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, in any order.

    ``tokenizer`` is a tokenizers BPE file; counts are those of its encoding without added special tokens, special
    strings inside a text taken as the special tokens. The words that are one token are proven once on the driver; their keys
    (64-bit hashes, at most one for each vocabulary entry) go to the tasks with the file. Null texts are empty: no bytes, no tokens. Null and repeated ids: a
    row each. No rows: no rows. Other columns are not read. A text of any length is counted whole, by itself.
    """
    spec = file_text(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((spec, proven_keys(vocabulary(spec))))
    rows = docs.select(F.col(key), F.col(text).alias("__dh_text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, proven = shared.value
        splitter, store = _worker(spec)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1), CHUNK_BYTES):
                pieces = splitter.split(data, offsets)
                tokens = arrays.span_sums(piece_counts(pieces, proven, store), pieces.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(tokens)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
