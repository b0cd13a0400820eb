"""Learn alert limits from a crash model's response curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from devicehealth.operators import explain, models
from devicehealth.operators.models import METRIC_FOREST, Size
from devicehealth.operators.quantiles import at_or_above_quantile
from devicehealth.schema import CRASHES, SPIKE_POSITION, THRESHOLD_FEATURES


def training_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str] = tuple(THRESHOLD_FEATURES), target: str = CRASHES,
                  prob: float = 0.9) -> DataFrame:
    """Complete readings in the top crash decile, split by key hash."""
    known = df.select(*keys, *features, target).na.drop(subset=[*features, target])
    return models.split_by_hash(at_or_above_quantile(known, target, prob), *keys)


def response_curves(df: DataFrame, keys: Sequence[str], features: Sequence[str] = tuple(THRESHOLD_FEATURES), target: str = CRASHES,
                    size: Size = METRIC_FOREST, points: int = explain.GRID_POINTS) -> DataFrame:
    """``(feature, i, x, prediction)`` of a forest over every feature's range; one scoring pass for the whole grid."""
    rows = training_rows(df, keys, features, target).persist()
    train, _ = models.parts(rows)
    model = models.forest_regression(train, features, target, size)
    grid = explain.response_grid(train, features, points)
    return model.transform(grid).select("feature", "i", "x", "prediction")


def thresholds_of(curves: DataFrame, positions: Mapping[str, int] = SPIKE_POSITION) -> DataFrame:
    """``(metric, threshold, spike_used, complete)`` from response curves."""
    return explain.nth_spike(explain.spikes(explain.gradient(curves)), positions)


def learn_thresholds(df: DataFrame, keys: Sequence[str], features: Sequence[str] = tuple(THRESHOLD_FEATURES), target: str = CRASHES,
                     size: Size = METRIC_FOREST, positions: Mapping[str, int] = SPIKE_POSITION) -> DataFrame:
    """Alert limits learned from readings; store them with ``write_thresholds``."""
    return thresholds_of(response_curves(df, keys, features, target, size), positions).withColumn("threshold", F.col("threshold").cast("double"))
