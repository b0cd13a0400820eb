"""Roll-ups, profiles, distributions and quantile-based labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from devicehealth.functions.numeric import flag, interval_label, percent_difference, round_half_even, total
from devicehealth.operators.quantiles import quantile_value, quantile_values, quantiles
from devicehealth.schema import CRASHES, EXTREME_HOST_CRASHES, HOST_METRICS, OVERVIEW_METRICS, SEGMENT_PERCENTILES


def host_means(df: DataFrame, host: str = "host_name", metrics: Sequence[str] = tuple(HOST_METRICS)) -> DataFrame:
    """Mean of each metric per host, hosts with every mean known."""
    means = df.where(F.col(host).isNotNull()).groupBy(host).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.na.drop()


def host_overview(df: DataFrame, host: str = "host_name", target: str = CRASHES,
                  metrics: Sequence[str] = tuple(OVERVIEW_METRICS), complete: bool = True) -> DataFrame:
    """Target sum, mean, max and count plus metric means per host, columns named ``metric_fn``."""
    out = df.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.coalesce(F.sum(target), F.lit(0.0)).alias(f"{target}_sum"),
        F.avg(target).alias(f"{target}_mean"),
        F.max(target).alias(f"{target}_max"),
        F.count(target).alias(f"{target}_count"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics])
    return out.na.drop() if complete else out


def host_crash_report(df: DataFrame, host: str = "host_name") -> DataFrame:
    """Rounded crash and load figures per host, as the extreme-host lists show them."""
    means = {"avg_cpu": "avg_processor_time", "avg_memory": "avg_memory_utilization", "avg_temp": "avg_cpu_temp",
             "avg_boot": "avg_boot_time", "avg_uptime": "uptime_days"}
    return df.where(F.col(host).isNotNull()).groupBy(host).agg(
        round_half_even(F.avg(CRASHES)).alias("avg_crashes"),
        round_half_even(F.coalesce(F.sum(CRASHES), F.lit(0.0))).alias("total_crashes"),
        F.count(CRASHES).alias("record_count"),
        round_half_even(F.max(CRASHES)).alias("max_crashes"),
        *[round_half_even(F.avg(m)).alias(name) for name, m in means.items()])


def extreme_hosts(report: DataFrame, above: float = EXTREME_HOST_CRASHES) -> DataFrame:
    return report.where(F.col("avg_crashes") > above).orderBy(F.desc("avg_crashes"))


def frequency(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value; missing values are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


def most_frequent(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return frequency(df, column).orderBy(F.desc("n"), F.col(column)).limit(k)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    names = ["count", "mean", "std", "min", "max"]
    stats = df.agg(*[
        f(F.col(c)).alias(f"{c}@{n}") for c in columns
        for n, f in zip(names, (F.count, F.avg, F.stddev_samp, F.min, F.max))])
    rows = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), *[F.col(f"`{c}@{n}`").cast("double").alias(n) for n in names]) for c in columns
    ])).alias("_s")).select("_s.*")
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("metric").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return rows.join(quartiles, "metric", "left").select("metric", F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
                                                        "p25", "p50", "p75", "max")


def group_profile(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Size and metric means per group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("size"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def ranked_means(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Group means, largest first."""
    return df.groupBy(group).agg(F.avg(metric).alias("mean")).orderBy(F.desc("mean"), F.col(group))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form ``(left, right, corr)``; all pairs come from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}@{b}") for a, b in pairs])

    def entry(a, b, value):
        return F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), value.alias("corr"))

    cells = [entry(c, c, F.lit(1.0)) for c in columns]
    for a, b in pairs:
        cells += [entry(a, b, F.col(f"`{a}@{b}`")), entry(b, a, F.col(f"`{a}@{b}`"))]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and positive rate of a 0/1 label."""
    return df.agg(F.count(label).alias("rows"), F.sum(label).alias("positives"), F.avg(label).alias("rate"))


def class_contrast(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric in the positive and negative class and the percent difference."""
    row = df.agg(*[
        F.avg(F.when(F.col(label) == k, F.col(m))).alias(f"{m}@{k}") for m in metrics for k in (1, 0)])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}@1`").alias("high"), F.col(f"`{m}@0`").alias("low")) for m in metrics]
    long = row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return long.withColumn("percent_difference", percent_difference(F.col("high"), F.col("low")))


def sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and mean rows per key, by counting each key once."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(F.sum("_n").alias("rows"), F.count(key).alias("keys"))


def medians_and_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, minimum and maximum per column."""
    row = df.agg(*[f(c).alias(f"{c}@{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    ends = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}@min`").cast("double").alias("min"), F.col(f"`{c}@max`").cast("double").alias("max"))
        for c in columns])).alias("_c")).select("_c.*")
    middle = quantiles(df, columns, [0.5]).select("metric", F.col("value").alias("median"))
    return ends.join(middle, "metric")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between minimum and maximum, last edge closed; empty bins are not listed."""
    value = F.col(column).cast("double")
    ends = F.col("_ends")
    bounded = df.where(value.isNotNull()).withColumn(
        "_ends", df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("_e")).select("_e").scalar())
    # A single-valued column is binned over a unit range around the value.
    spread = ends["high"] > ends["low"]
    low = F.when(spread, ends["low"]).otherwise(ends["low"] - 0.5)
    high = F.when(spread, ends["high"]).otherwise(ends["high"] + 0.5)
    position = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = bounded.groupBy(position.alias("bin"), F.col("_ends")).agg(F.count("*").alias("n"))
    return counted.select("bin", (low + (high - low) * F.col("bin") / bins).alias("edge"), "n")


def high_risk_summary(df: DataFrame, target: str, metrics: Sequence[str], prob: float = 0.9) -> DataFrame:
    """Threshold, size and metric means of the rows at or above the target's quantile."""
    threshold = quantile_value(df, target, prob)
    return df.where(F.col(target) >= F.lit(threshold)).agg(
        F.lit(threshold).alias("threshold"), F.count("*").alias("size"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def high_risk_label(df: DataFrame, target: str, prob: float = 0.9, name: str = "high_risk") -> DataFrame:
    """0/1 label: value at or above its own quantile."""
    return df.withColumn(name, flag(F.col(target) >= F.lit(quantile_value(df, target, prob))))


def _quantile_of_counts(counts: Sequence[tuple[float, int]], prob: float) -> float:
    """Linear quantile of values given with their frequencies, in order."""
    at = prob * (sum(n for _, n in counts) - 1)
    ends = [sum(n for _, n in counts[:i + 1]) for i in range(len(counts))]
    low, high = (next(v for (v, _), end in zip(counts, ends) if place < end) for place in (int(at), min(int(at) + 1, ends[-1] - 1)))
    return low + (high - low) * (at - int(at))


def extreme_flags(df: DataFrame, metrics: Sequence[str], prob: float = 0.9, score: str = "risk_score",
                  label: str = "high_risk", keep_flags: bool = False) -> DataFrame:
    """Count of metrics above their own quantile, and whether that count is above its own quantile."""
    limits = quantile_values(df, metrics, prob)
    flags = {f"_x_{m}": flag(F.col(m) > F.lit(limits.get(m))) for m in metrics}
    scored = df.withColumns(flags).withColumn(score, total([F.col(f) for f in flags]))
    # The count lies between 0 and the number of metrics, so a table of its frequencies gives its exact quantile in one pass.
    counts = sorted((r["v"], r["n"]) for r in scored.groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n")).collect())
    cut = _quantile_of_counts(counts, prob) if counts else None
    out = scored.withColumn(label, flag(F.col(score) > F.lit(cut)))
    if keep_flags:
        return out.withColumnsRenamed({f"_x_{m}": f"extreme_{m}" for m in metrics})
    return out.drop(*[f"_x_{m}" for m in metrics])


def crash_segments(df: DataFrame, column: str = CRASHES, probs: Sequence[float] = tuple(SEGMENT_PERCENTILES),
                   name: str = "segment") -> DataFrame:
    """Label rows by quantile segment ``(edge, next]``; repeated edges collapse, the lowest edge belongs to the first."""
    edges = sorted({row["value"] for row in quantiles(df, [column], probs).collect()})
    value = F.col(column)
    labels = [f"Segment {i + 1}" for i in range(len(edges) - 1)]
    label = interval_label(value, edges, labels)
    if labels:
        label = F.when(value == edges[0], F.lit(labels[0])).otherwise(label)
    return df.withColumn(name, label)


def recommendation_limits(df: DataFrame, label: str, metrics=("avg_processor_time", "avg_memory_utilization", "avg_boot_time")) -> DataFrame:
    """Metric means of the high-risk class: the limits to watch."""
    return df.where(F.col(label) == 1).agg(*[F.avg(m).alias(f"watch_{m}") for m in metrics])
