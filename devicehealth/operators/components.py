"""Connected components of an edge list by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from devicehealth.session import cut_lineage, let_go


def _mark(links: DataFrame) -> tuple:
    """Size and hash of the edges, in one aggregate: equal marks mean that a round changed nothing."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))"), F.expr("bit_xor(xxhash64(dst, src, 7))")).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``, the component named by its smallest node; lone nodes name themselves.

    Each round points every node at the smallest node it knows of, which ends after about log2(size)
    rounds. A round is two aggregates, which combine before the shuffle, and its result is checkpointed.
    """
    links = cut_lineage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = _mark(links)
    while mark[0]:
        # Large star: every neighbour above a node is pointed at the smallest node around it.
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("src", "_m").alias("_m"))
        large = both.where("dst > src").join(lowest, "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).where("src <> dst").distinct()
        # Small star: the node itself and its smaller neighbours are pointed at the smallest of them.
        smallest = large.groupBy("src").agg(F.min("dst").alias("_m"))
        small = large.join(smallest, "src").select(F.explode(F.array(F.struct("src", F.col("_m").alias("dst")),
                                                                     F.struct(F.col("dst").alias("src"), F.col("_m").alias("dst")))).alias("_e")).select("_e.*")
        links = cut_lineage(small.where("src <> dst").distinct())
        del both, lowest, large, smallest, small
        let_go(links.sparkSession)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return nodes.join(links.withColumnsRenamed({"src": "node", "dst": "_c"}), "node", "left").select(
        "node", F.coalesce("_c", "node").alias("component"))
