"""Order-dependent work on groups that may not fit one task.

A window over a whole group sorts it in one task. These operators cut the order into pieces first, so
each window sees one piece, and carry totals across pieces through a small table. Numbers are cut at
approximate quantiles; keys of several columns and texts are cut by Spark's range partitioner.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from devicehealth.session import cut_lineage, tasks_of

RANGES = 256


def _cut_points(df: DataFrame, column: str, ranges: int) -> tuple[list[float], set[float]]:
    """Range borders and the values so common that they fill ranges of their own."""
    found = [c for c in df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.5 / ranges) if abs(c) != math.inf]
    common = {c for c, times in Counter(found).items() if times > 1}
    # A common value is fenced in, so its range holds nothing else.
    return sorted({*found, *(math.nextafter(c, math.inf) for c in common)}), common


def _into_ranges(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the index of the value range a row falls in; missing values come first."""
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *cuts, math.inf]
    placed = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return placed.withColumn(name, F.coalesce(name, F.lit(-1.0)))


def order_pieces(df: DataFrame, keys: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Add ``_piece``: index of the stretch of the order by ``keys`` that a row falls in.

    The cuts are sampled whole keys, texts at full length, so no common prefix and no single large group
    ends up in one piece; rows equal in all keys stay together. The sample may differ between two runs of
    the same plan, so the dealt rows are written once and all readers see the same pieces.
    """
    dealt = df.repartitionByRange(pieces or tasks_of(df), *[F.col(k).asc_nulls_first() for k in keys])
    return cut_lineage(dealt.withColumn("_piece", F.spark_partition_id()))


def value_ranges(df: DataFrame, column: str, tie: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Add ``_range`` and ``_part``, which split the order by numeric value and tie columns into pieces.

    A value that many rows share is split further along the first tie column. The cut points are a few
    hundred approximate quantiles held on the driver; any cut points give right results, close ones
    balance the work.
    """
    cuts, common = _cut_points(df, column, ranges)
    cut = _into_ranges(df, column, cuts, "_range")
    if not tie or not common:
        return cut.withColumn("_part", F.lit(0.0))
    shared = F.col(column).isin(*common)
    numbered = cut.withColumn("_tie", F.col(tie[0]).cast("double"))
    borders, _ = _cut_points(numbered.where(shared), "_tie", ranges)
    parts = _into_ranges(numbered, "_tie", borders, "_part").drop("_tie")
    return parts.withColumn("_part", F.when(shared, F.col("_part")).otherwise(0.0))


def prefix_sums(df: DataFrame, column: str, sums: Sequence[str], by: Sequence[str] = (),
                tie: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add ``before_<c>``: sum of ``c`` over the rows of the group that sort before this one; missing values come first."""
    by, tie = list(by), list(tie)
    types = dict(df.dtypes)
    if any(types[c] == "string" for c in (column, *tie)):
        places, cut = ["_piece"], order_pieces(df, [*by, column, *tie], ranges)
    else:
        places, cut = ["_range", "_part"], value_ranges(df, column, tie, ranges or RANGES)
    piece = [*by, *places]
    totals = cut.groupBy(*piece).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*piece, *[
        F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_carry_{c}") for c in sums])
    within = Window.partitionBy(*piece).orderBy(column, *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(carried, piece)
    return joined.select(*df.columns, *[
        (F.col(f"_carry_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in sums])


def ordered_position(df: DataFrame, column: str, by: Sequence[str] = (), tie: Sequence[str] = (),
                     ranges: int | None = None) -> DataFrame:
    """Add ``position``: 1-based rank of a row in its group by value and tie columns."""
    counted = prefix_sums(df.withColumn("_one", F.lit(1)), column, ["_one"], by, tie, ranges)
    return counted.withColumn("position", (F.col("before__one") + 1).cast("bigint")).drop("_one", "before__one")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The rank filter lets Spark keep only ``k`` rows per group and partition before the shuffle.
    """
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key, as a partial aggregate rather than a sort of every key."""
    by, order = list(by), list(order)
    rest = [c for c in df.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(newest).select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, payload: Sequence[str], tie: str,
          inclusive: bool = True, pieces: int | None = None) -> DataFrame:
    """For each left row, the ``payload`` of the key's latest right row at or before it.

    Of several right rows at one time the one with the largest ``tie`` counts. Rows without key or time match nothing.
    Both sides are dealt by (key, time) into pieces of about equal size, so a key with very many rows, even within one
    day, spreads over as many tasks as its share of the rows; the last right row of earlier pieces comes from a table
    with one row per key and piece.
    """
    payload = list(payload)
    value = F.struct(F.col(time).alias("_at"), *payload)
    right_tagged = right.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
        F.col(by), F.col(time), F.col(tie), value.alias("_seen"), F.lit(0 if inclusive else 1).alias("_side"))
    row = F.struct(*left.columns).alias("_row")
    left_tagged = left.select(F.col(by), F.col(time), F.col(tie), row, F.lit(1 if inclusive else 0).alias("_side"))
    order = [time, "_side", tie]
    both = order_pieces(left_tagged.unionByName(right_tagged, allowMissingColumns=True), [by, *order], pieces)

    place = F.when(F.col("_seen").isNotNull(), F.struct(time, tie))
    last_in_piece = both.groupBy(by, "_piece").agg(F.max_by("_seen", place).alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in_piece.select(by, "_piece", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")

    within = Window.partitionBy(by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_now", F.last("_seen", ignorenulls=True).over(within)).where(F.col("_row").isNotNull())
    matched = seen.join(carried, [by, "_piece"], "left").withColumn("_hit", F.coalesce("_now", "_carry"))
    return matched.select("_row.*", F.col("_hit._at").alias(f"matched_{time}"), *[
        F.col(f"_hit.{c}").alias(f"matched_{c}") if c in left.columns else F.col(f"_hit.{c}").alias(c) for c in payload])
