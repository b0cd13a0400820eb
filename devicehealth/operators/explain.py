"""Response curves, spikes and root-cause shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from devicehealth.functions.numeric import total
from devicehealth.operators.clean import long_metrics
from devicehealth.operators.ordering import top_per_group
from devicehealth.operators.quantiles import quantile_values, quantiles
from devicehealth.operators.rollup import medians_and_ranges

GRID_POINTS = 50


def response_grid(df: DataFrame, features: Sequence[str], points: int = GRID_POINTS) -> DataFrame:
    """``(feature, i, x, *features)``: each feature swept over its range while the others sit at their median.

    One frame of ``features x points`` rows, so a model scores the whole grid at once.
    """
    stats = medians_and_ranges(df, features)
    medians = {row["metric"]: row["median"] for row in stats.collect()}
    step = F.col("min") + (F.col("max") - F.col("min")) * F.col("i") / (points - 1)
    swept = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        F.col("metric").alias("feature"), "i", step.alias("x"))
    return swept.select("feature", "i", "x", *[
        F.when(F.col("feature") == f, F.col("x")).otherwise(F.lit(medians.get(f))).alias(f) for f in features])


def gradient(curve: DataFrame, feature: str = "feature", i: str = "i", y: str = "prediction") -> DataFrame:
    """Add ``gradient``: central difference at unit step, one-sided at both ends."""
    along = Window.partitionBy(feature).orderBy(i)
    before, after = F.lag(y).over(along), F.lead(y).over(along)
    slope = (F.when(before.isNull(), after - F.col(y)).when(after.isNull(), F.col(y) - before).otherwise((after - before) / 2))
    return curve.withColumn("gradient", slope)


def spikes(curve: DataFrame, feature: str = "feature", i: str = "i", prob: float = 0.9) -> DataFrame:
    """Points whose gradient exceeds its own quantile per feature, numbered from 0 in grid order.

    A curve has as many points as the grid, so its quantile and ranking fit one task.
    """
    limits = curve.groupBy(feature).agg(F.percentile("gradient", F.lit(prob)).alias("_limit"))
    steep = curve.join(limits, feature).where(F.col("gradient") > F.col("_limit")).drop("_limit")
    return steep.withColumn("spike", F.row_number().over(Window.partitionBy(feature).orderBy(i)) - 1)


def nth_spike(spiked: DataFrame, positions: Mapping[str, int] | DataFrame, feature: str = "feature", x: str = "x") -> DataFrame:
    """``(metric, threshold, spike_used, complete)``: the wanted spike, or the last one where ties left fewer.

    Every wanted feature has a row: one whose curve is flat has no spike, a NULL threshold and is not complete.
    """
    wanted = (spiked.sparkSession.createDataFrame(list(positions.items()), "metric string, _wanted int") if isinstance(positions, Mapping)
              else positions.select(F.col(feature).alias("metric"), F.col("position").alias("_wanted")))
    known = spiked.select(F.col(feature).alias("metric"), F.col(x).alias("_x"), "spike")
    reachable = F.col("spike") <= F.col("_wanted")
    return wanted.join(known, "metric", "left").groupBy("metric").agg(
        F.max_by("_x", F.when(reachable, F.col("spike"))).alias("threshold"), F.max(F.when(reachable, F.col("spike"))).alias("spike_used"),
        F.coalesce(F.max(F.when(reachable, F.col("spike"))) == F.max("_wanted"), F.lit(False)).alias("complete"))


def contributions(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], importances: DataFrame,
                  prob: float = 0.9, lower_is_worse: set[str] = frozenset(), reference: DataFrame | None = None) -> DataFrame:
    """Long readings with ``raw_score = max(value past limit, 0) * importance``.

    Limits are the metric quantiles of ``reference`` (default: the frame itself); by default high values
    are risky for every metric, ``lower_is_worse`` turns the direction of the named ones.
    The joined limits hold one row per listed metric, which bounds the broadcast.
    """
    fleet = df if reference is None else reference
    high = [m for m in metrics if m not in lower_is_worse]
    limits = quantiles(fleet, high, [prob])
    low = [m for m in metrics if m in lower_is_worse]
    if low:
        limits = limits.unionByName(quantiles(fleet, low, [1 - prob]))
    per_metric = limits.select("metric", F.col("value").alias("threshold")).join(importances, "metric")
    joined = long_metrics(df, ids, metrics).join(F.broadcast(per_metric), "metric")
    past = F.col("value") - F.col("threshold")
    if low:
        past = F.when(F.col("metric").isin(low), -past).otherwise(past)
    return joined.withColumn("raw_score", F.greatest(past, F.lit(0.0)) * F.col("importance"))


def root_causes(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], importances: DataFrame | Mapping[str, float],
                top: int | None = None, prob: float = 0.9, lower_is_worse: set[str] = frozenset(),
                reference: DataFrame | None = None) -> DataFrame:
    """Share of each metric in a device's risk, in percent; positive shares only, largest first.

    The wide form scores a device in its own row: no regrouping of the long readings. Limits and
    importances, one number per metric, enter the plan as literals.
    """
    fleet = df if reference is None else reference
    if isinstance(importances, DataFrame):
        importances = {row["metric"]: row["importance"] for row in importances.select("metric", "importance").collect()}
    high = [m for m in metrics if m not in lower_is_worse]
    low = [m for m in metrics if m in lower_is_worse]
    limits = {**(quantile_values(fleet, high, prob) if high else {}), **(quantile_values(fleet, low, 1 - prob) if low else {})}

    def score(m):
        past = F.lit(limits.get(m)) - F.col(m) if m in low else F.col(m) - F.lit(limits.get(m))
        return F.greatest(F.coalesce(past, F.lit(0.0)), F.lit(0.0)) * F.lit(importances.get(m, 0.0))

    scored = df.select(*ids, *metrics, *[score(m).alias(f"_s_{m}") for m in metrics])
    whole = total([F.col(f"_s_{m}") for m in metrics])
    # Sorting on (-share, metric) puts the largest share first and breaks ties by name.
    shares = F.array_compact(F.array(*[
        F.when(F.col(f"_s_{m}") > 0, F.struct((-F.col(f"_s_{m}") / F.col("_whole") * 100).alias("minus"), F.lit(m).alias("metric"),
                                              F.col(m).cast("double").alias("value"))) for m in metrics]))
    ordered = F.array_sort(shares)
    listed = F.slice(ordered, 1, top) if top else ordered
    return (scored.withColumn("_whole", whole).where(F.col("_whole") > 0)
            .select(*ids, F.posexplode(listed).alias("_p", "_c"))
            .select(*ids, (F.col("_p") + 1).alias("rank"), F.col("_c.metric").alias("metric"), F.col("_c.value").alias("value"),
                    (-F.col("_c.minus")).alias("confidence")))


def ranked_importances(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    """Feature importances of a fitted model as ``(metric, importance)``, largest first."""
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "metric string, importance double").orderBy(F.desc("importance"), "metric")
