"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays, grouping
from devicehealth.llm.merges import Store, file_text, vocabulary
from devicehealth.session import cut_lineage

CHUNK_BYTES = 1 << 20
#: Documents of a block, on which islands work; islands of a block; rounds between migrations; generations of a round.
BLOCK, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 2, 2, 8, 4
#: A sequence with less room than this share of its capacity is settled after the first phase.
SETTLED = 128


@lru_cache(maxsize=1)
def _worker(text: str):
    vocab = vocabulary(text)
    return vocab.splitter(), Store(vocab.encode, vocab.special)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)``: documents as ids with ``end_id`` behind, long ones cut, the first piece the short one."""
    shared = docs.sparkSession.sparkContext.broadcast(file_text(tokenizer))
    texts = docs.select(F.col(key), F.col(text).alias("__dh_text"))
    schema = T.StructType([texts.schema[0], *(T.StructField(n, T.LongType()) for n in ("length", "ids_crc32", "start")), T.StructField("piece", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, store = _worker(shared.value)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1), CHUNK_BYTES):
                found = splitter.split(data, offsets)
                keys, at, back = np.unique(found.keys, return_index=True, return_inverse=True)
                rows = store.places(keys, found, at)[back]
                values, upto = arrays.ragged(store.values, store.offsets, rows)
                upto = upto[found.first]
                total = np.diff(upto) + 1
                ids = np.full(len(values) + b - a, end_id, "<u4")
                ids[np.arange(len(values)) + np.repeat(np.arange(b - a), np.diff(upto))] = values
                begin = upto[:-1] + np.arange(b - a)
                number = -(-total // capacity)
                first = total - (number - 1) * capacity
                owner = np.repeat(np.arange(b - a), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                raw = memoryview(ids.tobytes())
                low = (begin[owner] + start) * 4
                crc = [zlib.crc32(raw[x:x + n]) for x, n in zip(low.tolist(), (length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(piece, pa.int32())], names=schema.names)

    return texts.mapInArrow(run, schema)


_STATE = "block long, island int, items array<long>, sizes array<int>, population array<array<int>>"


def _as_bins(names: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(max(names)) + 1)]
    for i, b in enumerate(names):
        bins[b].append(i)
    return bins


def _as_names(bins: list[list[int]], n: int) -> list[int]:
    names = [0] * n
    for b, held in enumerate(bins):
        for i in held:
            names[i] = b
    return names


def _evolved(state: DataFrame, tasks: int, turn: int, capacity: int) -> DataFrame:
    """Each island's population after the generations of a round."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = [int(s) for s in row.sizes]
                grown = grouping.evolve(sizes, capacity, [_as_bins(p) for p in row.population], GENERATIONS, POPULATION,
                                        seed=hash((int(row.block), int(row.island), turn)))
                yield pd.DataFrame([(row.block, row.island, row.items, row.sizes, [_as_names(p, len(sizes)) for p in grown])], columns=list(frame.columns))

    return state.repartition(tasks, "block", "island").mapInPandas(run, _STATE)


def _packed(items: DataFrame, capacity: int, phase: int) -> DataFrame:
    """``(item, length, sequence_id, offset, room)`` of ``items(item, length)``, which are dealt to blocks by hash."""
    count = items.count()
    blocks = max(1, -(-count // BLOCK))
    tasks = max(1, -(-blocks * ISLANDS // 4))
    block = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(phase)), F.lit(blocks))).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"))
    state = block.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("held.item").alias("items"),
                         F.col("held.length").cast("array<int>").alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("population"))
    for turn in range(ROUNDS):
        if turn:
            # The best packing of each island moves to the next one, in the place of the worst there.
            elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("guest"))
            state = state.join(elite, ["block", "island"]).select(
                "block", "island", "items", "sizes", F.concat(F.slice("population", 1, POPULATION - 1), F.array("guest")).alias("population"))
        state = cut_lineage(_evolved(state, tasks, turn, capacity))
    best = state.select("block", "items", "sizes", F.col("population")[0].alias("names")).withColumn("n", F.array_max("names")).groupBy("block").agg(
        F.min_by(F.struct("items", "sizes", "names"), "n").alias("s")).select("block", "s.*")
    rows = best.select("block", F.explode(F.arrays_zip("items", "sizes", "names")).alias("z")).select(
        F.col("z.items").alias("item"), F.col("z.sizes").cast("long").alias("length"),
        (F.lit(phase << 60) + F.col("block") * (1 << 24) + F.col("z.names")).alias("sequence_id"))
    bins = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"), (F.lit(capacity) - F.sum("length")).alias("room"))
    return bins.select("sequence_id", "room", F.posexplode("held").alias("i", "z"), "held").select(
        F.col("z.item").alias("item"), F.col("z.length").alias("length"), "sequence_id", "room",
        F.expr("aggregate(slice(held, 1, i), 0L, (t, x) -> t + x.length)").alias("offset"))


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """``(item, sequence_id, offset)`` of ``lengths(item, length)`` with lengths from 1 to ``capacity`` and distinct items.

    A full-length item is a sequence of its own. The others are dealt by hash to blocks of a bounded expected size; on
    each block islands evolve packings and exchange their best between rounds. Then sequences with more than
    1/128 of the capacity left are broken up, and their items, now few, are dealt to new blocks and packed once more.
    """
    full = lengths.where(F.col("length") == capacity).select("item", (F.lit(3 << 60) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = cut_lineage(_packed(lengths.where(F.col("length") < capacity), capacity, 0))
    loose = F.col("room") > capacity // SETTLED
    again = _packed(first.where(loose).select("item", "length"), capacity, 1)
    columns = ["item", "sequence_id", "offset"]
    return full.unionByName(first.where(~loose).select(columns)).unionByName(again.select(columns))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece of a document.

    Null or empty text: the end id alone, one piece of length 1. Null and repeated ids: each row is a document of its
    own. A text longer than a sequence: as many full pieces as it fills, and a short one first. Ties (equal lengths): by
    row, packed alike at each run over the same checkpointed pieces. No rows: no rows. Other columns are not read.
    """
    cut = cut_lineage(pieces(docs, tokenizer, capacity, end_id, key, text).withColumn("item", F.monotonically_increasing_id()))
    place = pack(cut.select("item", "length"), capacity)
    return cut.join(place, "item").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
