"""Row detection: which metrics of a reading are past their limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from devicehealth.functions.numeric import to_number
from devicehealth.operators.clean import known_user_and_device
from devicehealth.schema import LOWER_IS_WORSE
from devicehealth.session import small

Thresholds = Mapping[str, float] | DataFrame


def is_past(value: Column, limit: Column, lower_is_worse: Column) -> Column:
    """Strictly past the limit on the bad side."""
    return F.when(lower_is_worse, value < limit).otherwise(value > limit)


def detect(df: DataFrame, thresholds: Thresholds, user: str = "auth_username", device: str = "model_name",
           lower_is_worse: set[str] = LOWER_IS_WORSE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(username, device, features)`` of every reading with a triggered metric, one record per reading.

    Wide form: each metric is compared in its own column, so nothing is exploded or shuffled.
    ``thresholds`` is a mapping, or a frame ``(metric, threshold)`` of which the few rows are fetched.
    """
    if not isinstance(thresholds, Mapping):
        thresholds = {row["metric"]: row["threshold"] for row in thresholds.select("metric", "threshold").collect()}
    limits = {m: F.lit(float(t)) for m, t in thresholds.items()}
    types = dict(df.dtypes)
    hits = [
        F.when((value < limit) if m in lower_is_worse else (value > limit), F.struct(F.lit(m).alias("metric"), value.alias("value")))
        for m, limit in limits.items() if m in df.columns
        for value in [to_number(F.col(m)) if types[m] == "string" else F.col(m).cast("double")]
    ]
    found = known_user_and_device(df, user, device).select(
        F.col(user).alias("username"), F.col(device).alias("device"), *keep,
        F.array_compact(F.array(*hits)).alias("_hits"))
    return found.where(F.size("_hits") > 0).select(
        "username", "device", *keep, F.map_from_entries("_hits").alias("features"))


def triggered_pairs(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Long readings ``(…, metric, value)`` joined to ``(metric, threshold, lower_is_worse)``, triggered rows only.

    The limits are broadcast while their row count is small: their few keys would make few, hot partitions.
    """
    joined = long.join(small(thresholds), "metric")
    return joined.where(is_past(F.col("value"), F.col("threshold"), F.col("lower_is_worse")))


def metric_keys(features: Column) -> Column:
    """List form of a record's features."""
    return F.map_keys(features)


def feature_lines(records: DataFrame) -> DataFrame:
    """Records to one row per triggered metric."""
    others = [c for c in records.columns if c != "features"]
    return records.select(*others, F.explode("features").alias("metric", "value"))
