"""Exact, linearly interpolated quantiles in bounded memory.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which a
fleet-wide metric outgrows. Here one scan brackets each wanted rank with a small sketch, and a second
one counts the rows below the bracket and the few values inside it, which are then ranked.
Both scans read only the columns asked for and aggregate before they shuffle. The result is exact for
finite values, and a bracket that missed its rank raises instead of answering wrongly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from devicehealth.operators.ordering import prefix_sums
from devicehealth.session import cut_lineage, small

SKETCH_ACCURACY = 2000
SMALL_GROUP = 50_000
# Beyond this many values in one group, the values inside a bracket are ranked range by range.
LARGE_GROUP = 500_000_000
BELOW = float("-inf")


def _sketch(columns: Sequence[str], probs: Sequence[float], accuracy: int) -> Column:
    """Struct of arrays, one slot per column and quantile: value count and the range sure to hold its ranks.

    Each column is sketched once for all its quantiles.
    """
    slack = 4.0 / accuracy
    edges = [0.0, 1.0] + [min(max(p + side, 0.0), 1.0) for p in probs for side in (-slack, slack)]
    counts, lows, highs = [], [], []
    for name in columns:
        few = F.count(name) <= SMALL_GROUP
        sketch = F.percentile_approx(name, edges, accuracy)
        for i in range(len(probs)):
            counts.append(F.count(name))
            lows.append(F.when(few, sketch[0]).otherwise(sketch[2 * i + 2]))
            highs.append(F.when(few, sketch[1]).otherwise(sketch[2 * i + 3]))
    return F.struct(F.array(*counts).alias("n"), F.array(*lows).alias("low"), F.array(*highs).alias("high"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Quantiles in long form: ``(*by, metric, prob, value)``.

    NULLs are ignored; a metric without values gives no row. Without ``by`` the brackets, three numbers per
    wanted quantile, are fetched first and enter the plan as literals.
    """
    by = list(by)
    columns = list(dict.fromkeys(columns))
    wanted = [(c, float(p)) for c in columns for p in probs]
    slots = range(len(wanted))
    source = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    for key in by:
        source = source.where(F.col(key).isNotNull())

    brackets = source.groupBy(*by).agg(_sketch(columns, probs, accuracy).alias("_q"))
    if by:
        # Written once, used twice. Few groups would make few, hot join partitions: broadcast those.
        brackets = cut_lineage(brackets)
        hinted = small(brackets)
        located = source.join(hinted, by)
        lows, highs = [[F.col(f"_q.{part}")[i] for i in slots] for part in ("low", "high")]
        largest = brackets.agg(F.max(F.array_max("_q.n"))).first()[0] or 0
    else:
        located = source
        fetched = brackets.first()["_q"]
        lows, highs, counts = [[F.lit(v) for v in fetched[part]] for part in ("low", "high", "n")]
        largest = max(fetched["n"])

    # Everything below a bracket becomes one value, counted before the shuffle like any other.
    # A plain explode stays in generated code.
    value = [F.when(F.col(c) < lows[i], F.lit(BELOW)).when(F.col(c) <= highs[i], F.col(c)) for i, (c, _) in enumerate(wanted)]
    counted = located.select(*by, F.posexplode(F.array(*value)).alias("_slot", "_value")).where(
        F.col("_value").isNotNull()).groupBy(*by, "_slot", "_value").agg(F.count("*").alias("_count"))
    if largest > LARGE_GROUP:
        seen = prefix_sums(cut_lineage(counted), "_value", ["_count"], [*by, "_slot"]).withColumn("_seen", F.col("before__count") + F.col("_count"))
    else:
        running = Window.partitionBy(*by, "_slot").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
        seen = counted.withColumn("_seen", F.sum("_count").over(running))

    slot = F.col("_slot")
    if by:
        seen = seen.join(hinted.select(*by, F.col("_q.n").alias("_n")), by)
        size = F.col("_n")[slot]
    else:
        size = F.array(*counts)[slot]
    names, levels = F.array(*[F.lit(c) for c, _ in wanted]), F.array(*[F.lit(p) for _, p in wanted])
    ranked = seen.select(*by, "_slot", "_value", "_seen", (levels[slot] * (size - 1)).alias("_rank"))
    found = ranked.groupBy(*by, "_slot").agg(
        F.max("_rank").alias("_rank"),
        F.min(F.when(F.col("_seen") > F.floor("_rank"), F.col("_value"))).alias("_low"),
        F.min(F.when(F.col("_seen") > F.ceil("_rank"), F.col("_value"))).alias("_high"),
    )
    missed = F.col("_low").isNull() | F.col("_high").isNull() | (F.col("_low") == BELOW)
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_rank") - F.floor("_rank"))
    return found.select(
        *by, names[slot].alias("metric"), levels[slot].alias("prob"),
        F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank; raise the accuracy")).cast("double"))
        .otherwise(between).alias("value"))


def quantile_values(df: DataFrame, columns: Sequence[str], prob: float) -> dict[str, float]:
    """One quantile of each column as driver-side limits; as literals they also reach the file scan."""
    return {row["metric"]: row["value"] for row in quantiles(df, columns, [prob]).collect()}


def quantile_value(df: DataFrame, column: str, prob: float) -> float | None:
    """One quantile of one column; None for a column without values."""
    return quantile_values(df, [column], prob).get(column)


def at_or_above_quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Rows at or above the column's own quantile."""
    return df.where(F.col(column) >= F.lit(quantile_value(df, column, prob)))
