"""Density clusters on a graph of grid cells.

Rows are put in cells so small that all rows of one cell are neighbours. A cell with enough rows is core without a distance, the
cores of a cell are one cluster, and components run over cells. Distances are only worked out between rows of cells whose
boxes come near enough, block against block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from devicehealth.operators.components import components
from devicehealth.operators.geometry import BLOCK_ROWS, distances
from devicehealth.operators.ordering import ordered_position
from devicehealth.session import cut_lineage, small, tasks_of

#: Axes of the coarse grid on which near cells are looked up; the boxes themselves are compared on all axes.
LOOKUP_AXES = 3


def _near_cells(cells: DataFrame, dimensions: int, side: float, eps: float) -> DataFrame:
    """``(_a, _b, _blocks_b)``: ordered pairs of cells whose boxes are within ``eps``, each cell with itself too."""
    reach = math.ceil(math.sqrt(dimensions)) + 1
    spans = cells.agg(*[(F.max(F.col("_at")[i]) - F.min(F.col("_at")[i])).alias(str(i)) for i in range(dimensions)]).first()
    axes = sorted(range(dimensions), key=lambda i: -(spans[i] or 0))[:LOOKUP_AXES]
    names = [f"_g{i}" for i in axes]
    coarse = [F.floor(F.col("_at")[i] / reach).alias(n) for i, n in zip(axes, names)]
    shifts = F.explode(F.array(*[F.array(*[F.lit(s) for s in shift]) for shift in product((-1, 0, 1), repeat=len(axes))]))
    asking = cells.select(F.col("_cell").alias("_a"), F.col("_at").alias("_at_a"), *coarse).withColumn("_s", shifts)
    asking = asking.select("_a", "_at_a", *[(F.col(n) + F.col("_s")[k]).alias(n) for k, n in enumerate(names)])
    asked = cells.select(F.col("_cell").alias("_b"), F.col("_at").alias("_at_b"), F.col("_blocks").alias("_blocks_b"), *coarse)
    # Between the boxes lies one cell less than their numbers differ by.
    gap = F.aggregate(F.zip_with("_at_a", "_at_b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")), F.lit(0.0), lambda t, g: t + g * g)
    return asking.join(asked, names).where(gap * F.lit(side * side) <= F.lit(eps * eps * (1 + 1e-6))).select("_a", "_b", "_blocks_b")


def _visit(visitors: DataFrame, hosts: DataFrame, run, schema: str, buckets: int) -> DataFrame:
    """``run(visitors, hosts)`` once for each block of a cell and part of its visitors; places are dealt to buckets, since most cells hold few rows."""
    place = ["_cell", "_block", "_part"]
    names = [part.split()[0].strip("`") for part in schema.split(", ")]
    tasks = tasks_of(hosts)

    def each(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        known = there.groupby(place, sort=False).indices
        met = [run(here.iloc[i], there.iloc[known[at]]) for at, i in here.groupby(place, sort=False).indices.items() if at in known]
        return pd.concat(met) if met else pd.DataFrame({n: [] for n in names})

    def dealt(frame: DataFrame):
        # New column identities, so the two sides of one frame stay apart.
        return frame.toDF(*frame.columns).withColumn("_bucket", F.pmod(F.xxhash64(*place), F.lit(buckets))).repartition(tasks, "_bucket").groupBy("_bucket")

    return dealt(visitors).cogroup(dealt(hosts)).applyInPandas(each, schema)


def dbscan(points: DataFrame, key: str, features: Sequence[str], eps: float = 1.5, min_rows: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Density clusters: ``(key, cluster, is_core)``, noise is -1.

    A row is core with at least ``min_rows`` rows within ``eps``, itself included. Clusters are the connected cores, numbered
    from 0 by smallest key; a border row joins the lowest-numbered cluster within reach. ``key`` is unique, features are not
    null. A cell's side is ``eps`` over the root of the number of features, less a billionth. Cells are cut into blocks of
    about ``block_rows`` rows, so a full cell is spread over tasks. What leaves a task: a count or a cluster for each visiting
    row, a link for each pair of cells. No rows: no rows.
    """
    features = list(features)
    kind = dict(points.dtypes)[key]
    side = eps / math.sqrt(len(features)) * (1 - 1e-9)
    placed = cut_lineage(points.select(key, *features, F.array(*[F.floor(F.col(f) / side) for f in features]).alias("_at")).withColumn(
        "_cell", F.array_join(F.col("_at").cast("array<string>"), "/")))
    cells = cut_lineage(placed.groupBy("_cell").agg(F.first("_at").alias("_at"), F.count("*").alias("_n"), F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks")))
    if cells.isEmpty():
        return points.select(key, F.lit(-1).cast("bigint").alias("cluster"), F.lit(False).alias("is_core")).where("false")
    pairs = cut_lineage(_near_cells(cells, len(features), side, eps))
    # A row meets each block of each near cell at most; a bucket gets about a block of such visits.
    visits = pairs.join(cells.select(F.col("_cell").alias("_a"), "_n"), "_a").agg(F.sum(F.col("_n") * F.col("_blocks_b"))).first()[0]
    buckets = max(tasks_of(placed), visits // block_rows + 1)
    block = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    rows = placed.drop("_at").join(small(cells.select("_cell", "_n", "_blocks")), "_cell").withColumn("_block", block)

    def values(frame: pd.DataFrame) -> np.ndarray:
        return frame[features].to_numpy(float)

    def calls(frame: DataFrame, *more: str) -> DataFrame:
        """Rows of cells with few rows, once for each block of each near cell."""
        return frame.select(key, *features, *more, F.col("_cell").alias("_a")).join(pairs, "_a").withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks_b") - 1))).select(key, *features, *more, F.col("_b").alias("_cell"), "_block", F.lit(0).alias("_part"))

    def count_near(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: here[key], "near": (distances(values(here), values(there)) <= eps).sum(axis=1)})

    hosts = rows.select(key, *features, "_cell", "_block", F.lit(0).alias("_part"))
    near = _visit(calls(rows.where(F.col("_n") < min_rows)), hosts, count_near, f"`{key}` {kind}, near bigint", buckets).groupBy(key).agg(F.sum("near").alias("near"))
    marked = cut_lineage(rows.join(near, key, "left").withColumn("is_core", F.coalesce((F.col("_n") >= min_rows) | (F.col("near") >= min_rows), F.lit(False))).drop("near"))
    cores = marked.where("is_core")

    # Each near pair of cells once: a block of the one visits each block of the other.
    def linked(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(here), bool)
        for start in range(0, len(there), 256):
            hit |= (distances(values(here), values(there.iloc[start:start + 256])) <= eps).any(axis=1)
        found = here["_from"][hit].unique()
        return pd.DataFrame({"src": found, "dst": there["_cell"].iloc[0]})

    with_core = cores.groupBy("_cell").agg(F.min(key).alias("_least"), F.first("_blocks").alias("_blocks"))
    core_pairs = pairs.where("_a < _b").join(with_core.select(F.col("_cell").alias("_a"), F.col("_blocks").alias("_blocks_a")), "_a").join(
        with_core.select(F.col("_cell").alias("_b")), "_b")
    callers = cores.select(*features, F.col("_cell").alias("_a"), F.col("_block").alias("_part")).join(core_pairs, "_a").select(
        *features, F.col("_a").alias("_from"), F.col("_b").alias("_cell"), F.explode(F.sequence(F.lit(0), F.col("_blocks_b") - 1)).alias("_block"), "_part")
    most = core_pairs.groupBy(F.col("_b").alias("_cell")).agg(F.max("_blocks_a").alias("_parts"))
    called = cores.select(*features, "_cell", "_block").join(most, "_cell").select(
        *features, "_cell", "_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    labelled = components(with_core.select(F.col("_cell").alias("node")), _visit(callers, called, linked, "src string, dst string", buckets))

    # Clusters are numbered by their smallest key, through the table of cells.
    named = labelled.join(with_core.select(F.col("_cell").alias("node"), "_least"), "node")
    first = named.groupBy("component").agg(F.min("_least").alias("_least"))
    numbered = ordered_position(first.withColumn("_order", F.col("_least").cast("double")), "_order", tie=["_least"]).select("component", (F.col("position") - 1).alias("cluster"))
    clusters = cut_lineage(labelled.join(numbered, "component").select(F.col("node").alias("_cell"), "cluster"))
    told = cores.join(small(clusters), "_cell").select(key, *features, "_cell", "_block", F.lit(0).alias("_part"), "cluster")

    def in_reach(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        close = distances(values(here), values(there)) <= eps
        best = np.where(close, there["cluster"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        hit = close.any(axis=1)
        return pd.DataFrame({key: here[key][hit], "border": best[hit]})

    border = _visit(calls(marked.where("not is_core")), told, in_reach, f"`{key}` {kind}, border bigint", buckets).groupBy(key).agg(F.min("border").alias("cluster"))
    others = marked.where("not is_core").select(key).join(border, key, "left").select(key, F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"), F.lit(False).alias("is_core"))
    return told.select(key, "cluster", F.lit(True).alias("is_core")).unionByName(others)
