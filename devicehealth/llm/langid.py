"""Language identification by prediction by partial matching: byte context trees of variable order, one for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.session import cut_lineage

#: Longest context in bytes.
ORDER = 4
#: A context, or a byte in a context, is held if it makes up this share of its language's bytes; so each order of a
#: language has at most 1 / SHARE of them, whatever the size of the corpus.
SHARE = 1 / 20_000
#: Grams a task holds before it passes them on.
HELD = 2_000_000
#: Bits of a byte that no context predicts.
UNIFORM = 8.0


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts, it and the ``order`` bytes before it as one number; a text begins as after line breaks."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    padded = np.full(len(data) + order * n, 10, np.uint64)
    at = np.arange(len(data)) + np.repeat(order * np.arange(1, n + 1), sizes)
    padded[at] = data
    code = np.zeros(len(data), np.uint64)
    for k in range(order, -1, -1):
        code = code << np.uint64(8) | padded[at - k]
    return code


def gram_counts(docs: DataFrame, text: str, label: str, order: int) -> DataFrame:
    """``(label, code, n)``: how often each gram occurs in the texts of each label; summed in tasks before the shuffle."""
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for name, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=schema.names)
            held.clear()

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, offsets in arrays.chunks(batch.column(0), 1 << 20):
                code = grams(data, offsets, order)
                for name in dict.fromkeys(names[a:b].tolist()):
                    mine = code if b - a == 1 else code[np.repeat(names[a:b] == name, np.diff(offsets))]
                    codes, n = np.unique(mine, return_counts=True)
                    if name in held:
                        both = np.concatenate([held[name][0], codes])
                        codes, back = np.unique(both, return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[name][1], n])).astype(np.int64)
                    held[name] = codes, n
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from passed()
        yield from passed()

    return docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).mapInArrow(run, schema).groupBy("label", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen statistics. ``entries[language][k]``: sorted grams of order k and their bits; ``escapes``: contexts and theirs."""

    languages: list[str]
    order: int
    entries: list[list[tuple[np.ndarray, np.ndarray]]]
    escapes: list[list[tuple[np.ndarray, np.ndarray]]]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram in each language."""
        out = np.empty((len(codes), len(self.languages)))
        for j in range(len(self.languages)):
            total = np.zeros(len(codes))
            open_ = np.arange(len(codes))
            for k in range(self.order, -1, -1):
                mine = codes[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
                hit, cost = _found(*self.entries[j][k], mine)
                total[open_[hit]] += cost[hit]
                open_, mine = open_[~hit], mine[~hit]
                known, escape = _found(*self.escapes[j][k], mine >> np.uint64(8))
                total[open_[known]] += escape[known]
            total[open_] += UNIFORM
            out[:, j] = total
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def train(docs: DataFrame, text: str = "text", label: str = "lang", order: int = ORDER, share: float = SHARE) -> Model:
    """Context trees of the rows' labels from all their texts; rows with a null text or label teach nothing.

    Escape method C: a byte seen c times in a context seen t times with d different bytes has the share c / (t + d); the
    rest, with that of bytes too rare to be held, is the escape to the context shorter by a byte.
    """
    found = cut_lineage(gram_counts(docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()), text, label, order))
    totals = {r["label"]: r["t"] for r in found.groupBy("label").agg(F.sum("n").alias("t")).collect()}
    names = sorted(totals)
    empty = (np.zeros(0, np.uint64), np.zeros(0))
    entries, escapes = ([[empty] * (order + 1) for _ in names] for _ in range(2))
    if not names:
        return Model(names, order, entries, escapes)
    masks = [(1 << 8 * (k + 1)) - 1 for k in range(order + 1)]
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND(F.lit(m)).alias("code")) for k, m in enumerate(masks))))
    nodes = found.select("label", orders.alias("g"), "n").groupBy("label", "g.k", "g.code").agg(F.sum("n").alias("n"))
    # At most 256 bytes follow a context, so its list is short.
    contexts = nodes.groupBy("label", "k", F.shiftrightunsigned("code", 8).alias("context")).agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), F.sort_array(F.collect_list(F.struct(F.col("code").bitwiseAND(F.lit(255)).alias("byte"), "n"))).alias("seen"))
    least = F.create_map(*(F.lit(x) for name in names for x in (name, max(2.0, share * totals[name]))))[F.col("label")]
    held = F.filter("seen", lambda s: s["n"] >= F.col("least"))
    kept = cut_lineage(contexts.withColumn("least", least).where((F.col("t") >= F.col("least")) | (F.col("k") == 0)).select(
        "label", "k", "context", (F.col("t") + F.col("d")).alias("whole"), held.alias("held")))
    rest = F.col("whole") - F.aggregate("held", F.lit(0).cast("long"), lambda t, s: t + s["n"])
    for to, column, rows in (
            (escapes, "context", kept.select("label", "k", "context", (-F.log2(rest / F.col("whole"))).alias("bits"))),
            (entries, "code", kept.select("label", "k", F.shiftleft("context", 8).alias("context"), "whole", F.explode("held").alias("s")).select(
                "label", "k", F.col("context").bitwiseOR(F.col("s.byte")).alias("code"), (-F.log2(F.col("s.n") / F.col("whole"))).alias("bits")))):
        for (name, k), part in rows.toPandas().groupby(["label", "k"]):
            part = part.sort_values(column)
            to[names.index(name)][k] = part[column].to_numpy(np.uint64), part["bits"].to_numpy(float)
    return Model(names, order, entries, escapes)


class _Costs:
    """Bits of the grams met by this task."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.codes, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of bits for sorted distinct codes."""
        if len(self.codes) > self.limit:
            self._clear()
        known, _ = _found(self.codes, self.codes, codes)
        new = codes[~known]
        if len(new):
            both = np.concatenate([self.codes, new])
            at = np.argsort(both, kind="stable")
            self.codes, self.bits = both[at], np.concatenate([self.bits, self.model.bits(new)])[at]
        return self.bits[np.searchsorted(self.codes, codes)]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``: the language of the shortest code of the whole text, and its share of
    the likelihood, each language as likely beforehand.

    A text that is null or has no letter, and any text if nothing was learned: ``und``, score 0. Ties: the first language
    in order of name. Repeated rows are scored alike. No rows: no rows. Other columns pass through, but
    for those named ``lang_pred`` or ``score``, which are replaced. A very long text is scored whole.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    clear = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*kept, F.when(clear, F.col(text)).alias("__dh_text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("__dh_pred", T.StringType()), T.StructField("__dh_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        costs = _Costs(model)
        for batch in batches:
            column = batch.column(len(batch.columns) - 1)
            for a, b, data, offsets in arrays.chunks(column, 1 << 20):
                part = batch.slice(a, b - a)
                if model.languages:
                    codes, back = np.unique(grams(data, offsets, model.order), return_inverse=True)
                    each = costs.of(codes)
                    total = np.empty((b - a, len(model.languages)))
                    for j in range(len(model.languages)):
                        run_sum = np.zeros(len(data) + 1)
                        np.cumsum(each[back, j], out=run_sum[1:])
                        total[:, j] = run_sum[offsets[1:]] - run_sum[offsets[:-1]]
                    best = total.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(total.min(axis=1)[:, None] - total, -1000)).sum(axis=1)
                    blank = np.array([not v.is_valid for v in column.slice(a, b - a)])
                    pred = ["und" if e else model.languages[j] for e, j in zip(blank.tolist(), best.tolist())]
                    share[blank] = 0.0
                else:
                    pred, share = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(share, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({"__dh_pred": "lang_pred", "__dh_score": "score"})
