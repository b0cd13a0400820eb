"""Filter interaction audit: five filters on every document, counted by the set of filters that it fails, in all their orders.

Whether a text repeats is asked of a counting Bloom sketch first: every task counts its texts' cells, the counts are merged by
shard, and a text one of whose cells was met once only is the only one of its kind. What is left is possibly repeated; only those
texts are shuffled, and grouped by the full text for the smallest id. Everything else is counted from bits of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.session import cut_lineage, small

FILTERS = "ABCDE"
#: Bit of the filter that needs the other documents.
REPEAT = 1 << FILTERS.index("E")
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 2, b"#$%&*|"
#: Cells of the sketch for each document, and of a shard of it. A text that is the only one of its kind is taken for a repeated one with a chance of 1.4 %.
CELLS, SHARD = 16, 1 << 20
#: Hashes that a task counts before it hands them on, and most cells that are sent to all tasks (beyond it they are joined).
HELD, SENT = 1 << 20, 1_000_000
_U = np.uint64
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    starts, ends, first = arrays.words(data, offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    h = arrays.spans_hash(data, starts, ends)
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=len(words))
    points = arrays.span_sums((data & 0xC0) != 0x80, offsets)
    upper = arrays.span_sums((data >= 65) & (data <= 90), offsets)
    sign = np.zeros(256, bool)
    sign[list(SIGNS)] = True
    failed = [words < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * points, arrays.span_sums(sign[data], offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def flagged(rows: DataFrame) -> DataFrame:
    """``(id, part, h, k, mask)`` of ``rows(id, part, h, k, text)``."""
    schema = T.StructType([*(rows.schema[c] for c in ("id", "part", "h", "k")), T.StructField("mask", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(4)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(own_failures(data, offsets), pa.int32())], names=schema.names)

    return rows.select("id", "part", "h", "k", "text").mapInArrow(run, schema)


def _cells(h, shards: int) -> list:
    """Two cells of a hash, as columns; both lie in one shard."""
    shard = F.shiftright(h, 40).bitwiseAND(shards - 1) * SHARD
    return [shard + h.bitwiseAND(SHARD - 1), shard + F.shiftright(h, 20).bitwiseAND(SHARD - 1)]


def crowded_cells(hashes: DataFrame, shards: int) -> DataFrame:
    """``(cell)`` that two or more of the texts' ``h`` met: a counting sketch for each task, merged shard by shard, counts stopping at two."""
    part = T.StructType([T.StructField("shard", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def counted(h: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(h)
        shard = ((h >> 40) & (shards - 1)) * SHARD
        # A text whose two cells are one counts once there.
        one, two = shard + (h & (SHARD - 1)), shard + ((h >> 20) & (SHARD - 1))
        cells, counts = np.unique(np.concatenate([one, two[two != one]]), return_counts=True)
        edge = np.flatnonzero(np.append(True, np.diff(cells // SHARD) > 0))
        ends = np.append(edge[1:], len(cells))
        return pa.RecordBatch.from_arrays(
            [pa.array(cells[edge] // SHARD, pa.int64()), pa.array([(cells[a:b] % SHARD).astype(np.int32).tobytes() for a, b in zip(edge, ends)], pa.binary()),
             pa.array([np.minimum(counts[a:b], 2).astype(np.uint8).tobytes() for a, b in zip(edge, ends)], pa.binary())], names=part.names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch.column(0).to_numpy())
                n += len(batch)
            if n >= HELD:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(SHARD, np.uint8)
        full = lambda: pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total > 1) + at * SHARD, pa.int64())], names=["cell"])
        for batch in batches:
            for shard, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if shard != at:
                    if at is not None:
                        yield full()
                    at, total = shard, np.zeros(SHARD, np.uint8)
                cells = np.frombuffer(cells.as_buffer(), np.int32)
                total[cells] = np.minimum(total[cells] + np.frombuffer(counts.as_buffer(), np.uint8), 2)
        if at is not None:
            yield full()

    return hashes.select("h").mapInArrow(sketch, part).repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "cell long")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)``: the documents of each part by the set of filters that they fail, bit 0 for A to bit 4 for E.

    A document fails A with under 200 words, B if 100 * distinct words < 50 * words, C if 100 * capital letters A-Z > 2 * code points, D if it holds one of ``#$%&*|``,
    E if a smaller id has the same text. Words are runs of other bytes than space and \\t to \\r.

    Null text: empty. Null part: the empty string. Null id: fails E never, and makes no other fail it. Rows that repeat id and text fail E alike; rows of labels that repeat an id count
    as good or toxic if one of them says so. Labels without a document are not counted. No rows: no rows. Other columns are not read.
    Words are told apart by 64-bit hashes, texts by their full text; a smallest id is known again by the id and two hashes of its text.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "*", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(11), F.col("text"), F.length("text")).alias("k"))
    shards = 1 << max(0, (docs.count() * CELLS - 1) // SHARD).bit_length()
    bits = cut_lineage(flagged(rows))
    crowded = cut_lineage(crowded_cells(bits, shards))

    def possible(rows: DataFrame) -> DataFrame:
        one, two = _cells(F.col("h"), shards)
        hint = small(crowded, SENT)
        rows = rows.where("id is not null").withColumns({"c1": one, "c2": two})
        return rows.join(hint.withColumnRenamed("cell", "c1"), "c1", "left_semi").join(hint.withColumnRenamed("cell", "c2"), "c2", "left_semi").drop("c1", "c2")

    firsts = possible(rows).groupBy("text").agg(F.min("id").alias("id")).select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(11), F.col("text"), F.length("text")).alias("k"))
    late = possible(bits).join(firsts, ["id", "h", "k"], "left_anti").select("id", "part", "mask", F.explode(F.array(F.lit(-1), F.lit(1))).alias("w"))
    # A document that comes late moves from its own mask to the one with the bit of E.
    moved = late.select("id", "part", F.when(F.col("w") > 0, F.col("mask").bitwiseOR(REPEAT)).otherwise(F.col("mask")).alias("mask"), "w")
    each = bits.select("id", "part", "mask", F.lit(1).alias("w")).unionByName(moved).groupBy("id", "part", "mask").agg(F.sum("w").alias("w")).where("w <> 0")
    marks = labels.groupBy(F.col(key).alias("id")).agg(F.max((F.col(quality) == 1).cast("long")).alias("good"), F.max((F.col(toxic) == 1).cast("long")).alias("bad"))
    counted = lambda c: F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0)))
    return each.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum("w").alias("n"), counted("good").alias("good"), counted("bad").alias("toxic"))


def audited(counts: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of ``mask_counts``: five steps for each of the 120 orders of the filters."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])
    masks = np.arange(1 << len(FILTERS))
    steps = [(order, s, 1 << FILTERS.index(order[s]), sum(1 << FILTERS.index(f) for f in order[:s])) for order in _ORDERS for s in range(len(FILTERS))]
    kept = np.array([masks & (bit | before) == 0 for _, _, bit, before in steps])
    removed = np.array([(masks & bit > 0) & (masks & before == 0) for _, _, bit, before in steps])
    redundant = np.array([(masks & bit > 0) & (masks & before > 0) for _, _, bit, before in steps])
    alone = np.array([masks == bit for _, _, bit, _ in steps])
    bits = np.array([bit for _, _, bit, _ in steps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, len(masks)), np.int64)
                for s in sets:
                    n[s["mask"]], good[s["mask"]], toxic[s["mask"]] = s["n"], s["good"], s["toxic"]
                gone = removed @ n
                share = {bit: int(gone[bits == bit].sum()) for bit in set(bits.tolist())}
                columns = [kept @ n, gone, redundant @ n, alone @ n, removed @ good, removed @ toxic, np.array([share[b] for b in bits.tolist()])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array([o for o, *_ in steps]), pa.array([s + 1 for _, s, *_ in steps], pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets")).mapInArrow(run, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter removes at each place of each order; see ``mask_counts`` for the filters and ``audited`` for the rows."""
    return audited(mask_counts(docs, labels, key, text, part))
