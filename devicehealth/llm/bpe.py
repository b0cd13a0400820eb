"""BPE encoding and decoding with a lexicon of frequent words as a minimal acyclic transducer; other words are merged exactly."""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays, automaton
from devicehealth.llm.merges import Store, file_text, vocabulary
from devicehealth.session import cut_lineage

CHUNK_BYTES = 1 << 20
#: Most words of a lexicon; the rest is merged exactly, so this bounds its size, not the result.
LEXICON_WORDS = 50_000


def word_counts(docs: DataFrame, text: str, shared) -> DataFrame:
    """``(word, n)`` over all texts, already summed for each batch of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = vocabulary(shared.value).splitter()
        for batch in batches:
            for _, _, data, offsets in arrays.chunks(batch.column(0), CHUNK_BYTES * 2):
                found = splitter.split(data, offsets)
                _, at, n = np.unique(found.keys, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([found.word(i) for i in at.tolist()], pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_file(docs: DataFrame, text: str, shared, words: int | None = None) -> str:
    """Compile the most frequent words of all texts; the file goes to every executor, its name there is returned."""
    spark = docs.sparkSession
    vocab = vocabulary(shared.value)
    words = LEXICON_WORDS if words is None else words
    counts = cut_lineage(word_counts(docs, text, shared).where(F.length("word") <= 64))
    # A table of words by steps of their logarithmic count tells the least count of at most so many words; only those are fetched.
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    upto = itertools.accumulate(r["words"] for r in steps)
    least = min((r["least"] for r, n in zip(steps, upto) if n <= words), default=None)
    frequent = [] if least is None else counts.where(F.col("n") >= least).select("word").collect()
    ordered = sorted(r.word.encode() for r in frequent if r.word not in vocab.special)
    values, offsets = vocab.encode(ordered)
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin")
    automaton.save(automaton.build(ordered, [values[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]), path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class _Words(Store):
    """Ids of the words met, by the lexicon or else by merging, with the decoded string of each."""

    def __init__(self, text: str, lexicon: automaton.Lexicon):
        self.vocab, self.lexicon = vocabulary(text), lexicon
        self.strings: list[str] = []
        super().__init__(self._encode, self.vocab.special, limit=150_000)

    def _clear(self) -> None:
        super()._clear()
        self.strings = []

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number = self.lexicon.numbers(words)
        known = number >= 0
        merged, upto = self.vocab.encode([words[i] for i in np.flatnonzero(~known).tolist()])
        sizes = np.zeros(len(words), np.int64)
        sizes[known] = self.lexicon.offsets[number[known] + 1] - self.lexicon.offsets[number[known]]
        sizes[~known] = np.diff(upto)
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        values = np.zeros(out[-1], np.int64)
        mask = np.repeat(known, sizes)
        values[mask] = arrays.ragged(self.lexicon.values, self.lexicon.offsets, number[known])[0]
        values[~mask] = merged
        return values, out

    def decoded(self) -> list[str]:
        """The decoded string of every row: its tokens, a space between, as the file names no decoder."""
        tokens = self.vocab.tokens
        for row in range(len(self.strings), len(self.offsets) - 1):
            self.strings.append(" ".join([tokens[i] for i in self.values[self.offsets[row]:self.offsets[row + 1]].tolist()]))
        return self.strings


@lru_cache(maxsize=1)
def _worker(text: str, name: str):
    return vocabulary(text).splitter(), _Words(text, automaton.Lexicon(SparkFiles.get(name)))


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``(key, n_tokens, ids, decoded, ids_sha256, decoded_sha256)`` for each row; without ``with_ids``, the lists and
    decoded texts themselves are left out.

    ``tokenizer`` is a tokenizers BPE file with word ends and no decoder; ids are those of its encoding without added special tokens, truncation
    or padding; ``decoded`` is its decoding of them, special tokens included. Words are counted over all texts, the most frequent are compiled
    into the lexicon; a word outside it is merged rank by rank. Null and empty texts: no ids and an empty decoded text.
    Null and repeated ids: a row each. No rows: no rows. Other columns are not read. A very long text is worked on by
    itself, whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file_text(tokenizer))
    rows = docs.select(F.col(key), F.col(text).alias("__dh_text"))
    name = lexicon_file(rows, "__dh_text", shared)
    lists = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_ids else []
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), *lists,
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, store = _worker(shared.value, name)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1), CHUNK_BYTES):
                found = splitter.split(data, offsets)
                keys, at, back = np.unique(found.keys, return_index=True, return_inverse=True)
                places = store.places(keys, found, at)[back]
                values, upto = arrays.ragged(store.values, store.offsets, places)
                upto = upto[found.first]
                strings = store.decoded()
                raw = memoryview(values.astype("<u4").tobytes())
                said = list(map(strings.__getitem__, places.tolist()))
                first = found.first.tolist()
                texts = [" ".join(said[x:y]) for x, y in zip(first[:-1], first[1:])]
                bounds = upto.tolist()
                made = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values.astype(np.int32))), pa.array(texts, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(upto), pa.int64()), *made,
                     pa.array([hashlib.sha256(raw[4 * x:4 * y]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:])]),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded_text``, the decoding of their ids; null ids give a null, no ids an empty text. A column of that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(file_text(tokenizer))
    kept = [c for c in encoded.columns if c.lower() != "decoded_text"]
    encoded = encoded.select(*kept)
    schema = T.StructType([*encoded.schema, T.StructField("decoded_text", T.StringType())])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(shared.value).tokens
        for batch in batches:
            texts = [None if one is None else " ".join([tokens[i] for i in one]) for one in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
