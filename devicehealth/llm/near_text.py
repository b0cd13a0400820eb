"""Near-duplicate texts: fast similarity sketches of word shingles, banding, and verification on the full sets.

The sketch follows Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, 2017): in round i each element is
hashed to a bin and a value; a bin keeps the least (round, value). Most bins fill in the first rounds; after as many
rounds as there are bins, round i puts every element into bin i, so that no bin can stay empty. Bins of two sets are
equal with a probability of their similarity, with concentration as for independent choices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.operators.components import components
from devicehealth.session import cut_lineage, let_go, small

WORDS = 5
#: Bands and bins in a band. A pair of similarity 0.8 misses all bands with a chance below 7e-6, one of 0.85 below 3e-8.
BANDS, ROWS = 30, 5
#: Most candidate ids sent to all tasks that read the texts a second time (a few MB); beyond it the texts are joined.
WANTED = 200_000
#: Most pairs sent to all tasks that hold sets (a few MB); beyond it the sets are shuffled to them.
PAIRS = 200_000
_SEED = np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one list after another, and their offsets.

    Letters A-Z are lowered first. A text of fewer words than ``width`` is one shingle, one without words has none.
    """
    n = len(offsets) - 1
    data = arrays.LOWER[data]
    starts, ends, first = arrays.words(data, offsets)
    h = arrays.spans_hash(data, starts, ends)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    weights = arrays.mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    if len(h) >= width:
        whole = sum(h[k:len(h) - width + 1 + k] * weights[k] for k in range(width))
        whole = arrays.mix(whole)
    else:
        whole = np.zeros(0, np.uint64)
    lists = []
    sizes = np.zeros(n, np.int64)
    single = dict.fromkeys(short.tolist())
    for d in single:
        part = h[first[d]:first[d + 1]]
        single[d] = arrays.mix((part * weights[:len(part)]).sum(keepdims=True) + _SEED // np.uint64(len(part)))
    for d in range(n):
        if count[d] >= width:
            lists.append(np.unique(whole[first[d]:first[d + 1] - width + 1]))
        elif count[d]:
            lists.append(single[d])
        else:
            continue
        sizes[d] = len(lists[-1])
    out = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(lists) if lists else np.zeros(0, np.uint64)), out


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each set; rows of empty sets are left at the largest value."""
    n = len(offsets) - 1
    out = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(offsets)
    open_rows = np.flatnonzero(sizes)
    salts = _SEED + np.arange(2 * bins, dtype=np.uint64) * _STEP
    for i in range(2 * bins):
        if not len(open_rows):
            break
        x, at = arrays.ragged(values, offsets, open_rows)
        row = np.repeat(open_rows, np.diff(at))
        h = arrays.mix(x ^ salts[i])
        where = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if i < bins else np.full(len(x), i - bins, np.uint64)
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out.reshape(-1), row * bins + where.astype(np.int64), value)
        open_rows = open_rows[(out[open_rows] == np.iinfo(np.uint64).max).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket key for each band of each sketch."""
    weights = arrays.mix(np.arange(1, rows + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    keys = (sketch.reshape(len(sketch), bands, rows) * weights).sum(axis=2, dtype=np.uint64)
    return arrays.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _SEED)


def sketch_table(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """``(id, n, set_a, set_b, bands)`` of every row: size and hash of its set, and its bucket keys (none for an empty set)."""
    rows_in = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows_in.schema["id"], T.StructField("n", T.LongType()), T.StructField("set_a", T.LongType()),
                           T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                values, at = shingle_sets(data, offsets, width)
                keys = band_keys(sketches(values, at, bands * rows), bands, rows)
                sizes = np.diff(at)
                sums = [np.add.reduceat(np.append(arrays.mix(values ^ salt), np.uint64(0)), at[:-1]) * (sizes > 0) if b > a else []
                        for salt in (_SEED, _STEP)]
                filled = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums),
                     pa.ListArray.from_arrays(pa.array(filled), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))],
                    names=schema.names)

    return rows_in.mapInArrow(run, schema)


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """``(id, shingles)`` of ``docs(id, text)``."""
    schema = T.StructType([docs.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                values, at = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with their ``shared`` shingles by the full sets, and whether they reach the similarity."""
    both = sets.withColumnsRenamed({"id": "a", "shingles": "sa"}).join(pairs, "a").join(
        sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), (F.size("sa") + F.size("sb")).alias("all"))
    return sized.select("a", "b", "shared", (F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("all") - F.col("shared"))).alias("ok"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``: one row for each distinct id.

    Documents are linked when 100 * common shingles >= ``percent`` * all shingles of the two; the component is named by
    its smallest id, whose row is kept. Candidates share a bucket of a band; every link is confirmed on the full sets.
    Documents of equal sets are one class, compared once.

    No bucket emits all its pairs. First the member that meets most others in all buckets is compared with the rest of
    its buckets; in a group of near copies that is the copied text, so the bucket becomes one component. While a bucket
    holds several components, more members (four, then four times as many each round, until all have been) are compared
    with those of other components. A pair is left out only if it cannot be a link: shingles that no other candidate has
    are never shared, which bounds the similarity of the pair from above, by itself and through the member compared first.

    Null ids: one row each, no component, kept. Null, empty or blank texts: no shingles, linked with nothing. A
    repeated id is one document, that of its largest set. Ties: the smallest id. No rows: no rows. Other columns are not read.
    Set equality and sizes rest on 64-bit shingle hashes (two of them for a whole set).
    """
    found = cut_lineage(sketch_table(docs, key, text, width, bands, rows))
    nameless = found.where("id is null").select("id", "n", F.lit(None).cast(found.schema["id"].dataType).alias("component"))
    one = found.where("id is not null").groupBy("id").agg(F.max(F.struct("n", "set_a", "set_b")).alias("s")).select("id", "s.*")
    classes = found.where("id is not null and n > 0").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))

    placed = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut_lineage(placed.join(crowded, "bucket"))
    del placed, crowded
    let_go(docs.sparkSession)
    wanted = cut_lineage(members.groupBy("rep", "n").agg(F.sum(F.col("m") - 1).alias("met")))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(small(wanted.select(F.col("rep").alias("id")), WANTED), "id", "left_semi")
    sets = set_table(texts, width).join(wanted.select(F.col("rep").alias("id"), "n"), "id").where("size(shingles) = n").groupBy("id").agg(
        F.first("shingles").alias("shingles"))
    sets = cut_lineage(sets)
    let_go(docs.sparkSession)

    def common_shingles(sets: DataFrame) -> DataFrame:
        """``(rep, common)``: how many shingles of a set occur in another set too."""
        alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
        return sets.join(alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone")), "id", "left").select(
            F.col("id").alias("rep"), (F.size("shingles") - F.coalesce("alone", F.lit(0))).alias("common"))

    members = cut_lineage(members.join(common_shingles(sets), "rep").join(wanted.select("rep", "met"), "rep").withColumn("u", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / F.lit(float(1 << 40))))

    let_go(docs.sparkSession)

    def possible(n, common, n2, common2):
        top = F.least(common, common2)
        return F.lit(100) * top >= F.lit(percent) * (n + n2 - top)

    def unsettled(rows: DataFrame) -> DataFrame:
        """Members whose bucket holds several components and a member as small as makes a link possible, with the best-connected one."""
        known = rows.join(labels.withColumnRenamed("node", "rep"), "rep")
        bounds = known.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("least"),
                                             F.max_by(F.struct("rep", "n", "common"), F.struct("met", F.xxhash64("rep"))).alias("first")).where("c0 <> c1")
        return cut_lineage(known.join(bounds, "bucket").where(
            possible(F.col("n"), F.col("common"), F.greatest(F.col("least"), F.col("common")), F.col("common"))).drop("c0", "c1", "least"))

    def named(found: DataFrame) -> DataFrame:
        return cut_lineage(components(wanted.select(F.col("rep").alias("node")), found.withColumnsRenamed({"a": "src", "b": "dst"})))

    pair = [F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")]
    labels = wanted.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    active = unsettled(members).withColumn("c", F.col("first.rep")).where("rep <> c")
    tried = active.where(possible(F.col("n"), F.col("common"), F.col("first.n"), F.col("first.common"))).select(*pair).distinct()
    checked = cut_lineage(_compared(small(cut_lineage(tried), PAIRS), sets, percent))
    let_go(docs.sparkSession)
    links = checked.where("ok").select("a", "b")
    labels = named(links)
    # What a member shares with any other lies in the first one if all its shingles but those that it alone has do (``inner``), and it is no smaller.
    # Then who is not linked with the first one is not linked with it either; and if it is linked itself, it is done.
    seen = active.withColumns({"a": pair[0], "b": pair[1]}).join(checked, ["a", "b"], "left").select(
        "bucket", "rep", "n", "common", "met", "u", F.coalesce("ok", F.lit(False)).alias("linked"),
        F.coalesce((F.col("shared") == F.col("common")) & (F.col("n") >= F.col("first.n")), F.lit(False)).alias("inner")).where("not (linked and inner)")
    sizes = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    active = cut_lineage(seen.join(sizes, "bucket"))
    left = sets.join(active.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    active = cut_lineage(active.drop("common").join(common_shingles(left), "rep"))
    del seen, sizes, left, tried, checked, members, texts
    let_go(docs.sparkSession)
    low, high, most = 0, 4, active.agg(F.max("m")).first()[0] or 0
    while low < most:
        known = unsettled(active)
        chosen = (F.col("u") * F.col("m") >= low) & (F.col("u") * F.col("m") < high)
        centres = known.where(chosen).select("bucket", F.col("rep").alias("c"), F.col("n").alias("cn"), F.col("common").alias("cs"), F.col("component").alias("cc"),
                                             F.col("linked").alias("cl"), F.col("inner").alias("ci"))
        excluded = (F.col("inner") & ~F.col("cl")) | (F.col("ci") & ~F.col("linked"))
        pairs = known.where(F.col("u") * F.col("m") >= low).join(centres, "bucket").where("component <> cc").where(~excluded).where(
            possible(F.col("n"), F.col("common"), F.col("cn"), F.col("cs"))).select(*pair).distinct()
        new = cut_lineage(_compared(pairs, sets, percent).where("ok").select("a", "b"))
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = named(links)
        active = known.drop("component", "first").where(F.col("u") * F.col("m") >= high)
        del known, centres, pairs, new
        let_go(docs.sparkSession)
        if active.isEmpty():
            break
        low, high = high, high * 4
    label = classes.select(F.col("rep").alias("node")).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    of_class = classes.select("n", "set_a", "set_b", F.col("rep").alias("node")).join(label, "node").drop("node")
    result = one.join(of_class, ["n", "set_a", "set_b"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return result.unionByName(nameless).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One document of each group of near copies, with its own columns; of rows that repeat an id all stay."""
    gone = near_duplicates(docs, key, text, percent).where("not kept").select(F.col(key).alias("__dh_gone"))
    return docs.join(gone, F.col(key) == F.col("__dh_gone"), "left_anti")
