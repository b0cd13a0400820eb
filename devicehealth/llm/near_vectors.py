"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, and verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.operators.components import components
from devicehealth.session import cut_lineage

#: Tables, rotations joined in the hash of a table, and buckets that a vector is put in for each table. Two vectors of
#: cosine 0.98 in 64 dimensions share a bucket of one table with a chance of 0.92, of none of them with one below 3e-7.
TABLES, ROTATIONS, PROBES = 6, 3, 4
#: Vectors of one side of a comparison; a larger bucket is compared block by block.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows times the Hadamard matrix of their length, a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=256)
def _signs(width: int, table: int, rotation: int) -> np.ndarray:
    return np.random.default_rng([width, table, rotation]).choice([-1.0, 1.0], (3, width))


def bucket_codes(x: np.ndarray, tables: int, rotations: int, probes: int) -> np.ndarray:
    """``tables * probes`` codes for each unit vector: its own bucket of a table, then those nearest to it.

    A rotation is three rounds of random signs and a Hadamard transform; the hash is the coordinate of the largest size, with its
    sign. The other buckets put the second or third coordinate in place of the first for one rotation, or the second for two, in
    the order of what that loses.
    """
    n, d = x.shape
    width = max(4, 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    out = np.zeros((n, tables, probes), np.uint64)
    for t in range(tables):
        base = np.zeros(n, np.int64)
        moves, losses = [], []
        first = []
        for r in range(rotations):
            y = x
            for signs in _signs(width, t, r):
                y = hadamard(y * signs)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :3]
            code = (top + width * (np.take_along_axis(y, top, 1) < 0)) * (2 * width) ** r
            size = np.take_along_axis(size, top, 1)
            base += code[:, 0]
            for k in (1, 2):
                moves.append(code[:, k] - code[:, 0])
                losses.append(size[:, 0] - size[:, k])
            first.append((code[:, 1] - code[:, 0], size[:, 0] - size[:, 1]))
        for a in range(rotations):
            for b in range(a):
                moves.append(first[a][0] + first[b][0])
                losses.append(np.hypot(first[a][1], first[b][1]))
        order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, :probes - 1]
        codes = np.concatenate([base[:, None], base[:, None] + np.take_along_axis(np.stack(moves, 1), order, 1)], 1)
        out[:, t] = arrays.mix(codes.astype(np.uint64) * np.uint64(tables) + np.uint64(t) + np.uint64(d << 44))
    return out.reshape(n, tables * probes)


def _unit(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which rows hold a vector that can be linked, and by length: the rows and their unit vectors."""
    by_length: dict[int, tuple[list, list]] = {}
    good = np.zeros(len(column), bool)
    for i, value in enumerate(column):
        held = value.as_py()
        if held and None not in held:
            v = np.array(held, np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(v).max()
                if np.isfinite(scale) and scale > 0:
                    v = v / scale
                    good[i] = True
                    at = by_length.setdefault(len(v), ([], []))
                    at[0].append(i)
                    at[1].append(v / np.sqrt(v @ v))
    return good, {d: (np.array(rows), np.array(vectors)) for d, (rows, vectors) in by_length.items()}


def _links(codes: np.ndarray, key: int, tables: int, probes: int, x: np.ndarray, y: np.ndarray | None, cosine: float, ycodes: np.ndarray | None):
    """``(close, counted)`` matrices of one block, or of two: pairs that reach the cosine, and those of them that this bucket is the first to hold."""
    one = y is None
    close = (x @ (x if one else y).T) >= cosine
    if one:
        np.fill_diagonal(close, False)
    a, b = np.nonzero(close)
    other = codes if one else ycodes
    table = int(np.flatnonzero((codes[0] == key).reshape(tables, probes).any(axis=1))[0])
    ours = np.ones(len(a), bool)
    for t in range(table + 1):
        left, right = codes[a, t * probes:(t + 1) * probes], other[b, t * probes:(t + 1) * probes]
        for p in range(probes):
            for q in range(probes):
                same = left[:, p] == right[:, q]
                ours &= ~same if t < table else ~(same & (left[:, p] < key))
    counted = np.zeros_like(close)
    counted[a[ours], b[ours]] = True
    return close, counted


def _roots(close: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric matrix."""
    label = np.arange(len(close))
    while True:
        lowest = np.minimum(label, np.where(close, label[None, :], len(label)).min(axis=1))
        lowest = lowest[lowest]
        if (lowest == label).all():
            return label
        label = lowest


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", cosine: float = 0.98,
                 tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row: vectors of the same group are linked at ``cosine`` and above.

    Cosines are in double precision. Equal vectors of a group are one class with a weight, hashed once. Classes that share a bucket are
    candidates; a bucket with more than ``block`` classes is compared block against block, each pair of blocks in a
    task of its own, and what leaves a task is a count and a root for each class, never pairs. A pair that shares
    several buckets is counted in the first of them. The arithmetic of a group of vectors that are all near each other stays quadratic.

    A null group or vector, a vector without components, of zeros, or with a null or non-finite component links with
    nothing; so do vectors of different lengths, and a row whose id is null (component null, kept). A repeated id: each row is a vector.
    Ties: the smallest id names the component. No rows: no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(group).alias("label"), F.col(vector).alias("vector")).withColumns(
        {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(17), "vector", "label")})
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    classes = rows.where(usable).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("salt", F.xxhash64("label"))
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), classes.schema["rep"], T.StructField("w", T.LongType()), T.StructField("cls", T.LongType()),
                           T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("codes", T.ArrayType(T.LongType()))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4 * block):
                part = batch.slice(a, 4 * block)
                salt = arrays.mix(part.column(5).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                units: list = [None] * len(part)
                codes: list = [None] * len(part)
                for at, x in _unit(part.column(6))[1].values():
                    found = arrays.mix(bucket_codes(x, tables, rotations, probes) ^ salt[at][:, None]).view(np.int64)
                    for i, u, c in zip(at.tolist(), x, found):
                        units[i], codes[i] = u, c
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(units, pa.list_(pa.float64())), pa.array(codes, pa.list_(pa.int64()))], names=schema.names)

    classes = cut_lineage(classes.select("h1", "h2", "rep", "w", "cls", "salt", "vector").mapInArrow(coded, schema).where("codes is not null"))
    placed = classes.select("cls", F.explode("codes").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / block).cast("int")
    dealt = placed.join(crowded, "bucket").select("cls", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("cls", "bucket"), parts).cast("int").alias("side"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cls", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    work = dealt.join(classes.select("cls", "w", "unit", "codes"), "cls").select("bucket", "i", "j", "side", "cls", "w", "unit", "codes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield from found(table.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
                held = table.slice(cuts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            yield from found(table, np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(table)]]))

    def found(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts and roots of the groups between the cuts."""
        bucket, i, j, side, cls, w = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "cls", "w"))
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        units = table.column("unit").combine_chunks()
        upto, flat = units.offsets.to_numpy(), units.values.to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            size = upto[a + 1] - upto[a]
            x = flat[upto[a]:upto[b]].reshape(b - a, size)
            if i[a] == j[a]:
                close, counted = _links(codes[a:b], bucket[a], tables, probes, x, None, cosine, None)
                n = counted @ w[a:b]
            else:
                left, right = np.flatnonzero(side[a:b] == i[a]), np.flatnonzero(side[a:b] == j[a])
                if not len(left) or not len(right):
                    continue
                part, mine = _links(codes[a:b][left], bucket[a], tables, probes, x[left], x[right], cosine, codes[a:b][right])
                close = np.zeros((b - a, b - a), bool)
                close[np.ix_(left, right)] = part
                close |= close.T
                n = np.zeros(b - a, np.int64)
                n[left], n[right] = mine @ w[a:b][right], mine.T @ w[a:b][left]
            some = close.any(axis=1)
            if some.any():
                out.append((cls[a:b][some], n[some], cls[a:b][_roots(close)][some]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["cls", "n", "root"])

    counts = cut_lineage(work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compared, "cls long, n long, root long"))
    label = components(classes.select(F.col("cls").alias("node")), counts.select(F.col("cls").alias("src"), F.col("root").alias("dst")).where("src <> dst").distinct())
    named = classes.select("h1", "h2", "rep", "w", "cls").join(label.withColumnRenamed("node", "cls"), "cls").join(
        counts.groupBy("cls").agg(F.sum("n").alias("n")), "cls", "left")
    named = cut_lineage(named)
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = named.join(lowest, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), "component_id")
    able = rows.where(usable).select("id", "h1", "h2").join(result, ["h1", "h2"], "left")
    unable = rows.where(~usable).select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast(rows.schema["id"].dataType).alias("component_id"))
    return able.select("id", "links", "component_id").unionByName(unable).select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))
