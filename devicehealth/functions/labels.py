"""Rule-based labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from devicehealth.functions.numeric import interval_label
from devicehealth.schema import CRASH_BINS_5, CRASH_BINS_6


def crash_severity(col: Column) -> Column:
    """Five-way crash severity."""
    return interval_label(col, *CRASH_BINS_5)


def crash_severity_fine(col: Column) -> Column:
    """Six-way crash severity."""
    return interval_label(col, *CRASH_BINS_6)


def diagnosis(metric=F.col) -> Column:
    """First matching fault rule of a reading; ``metric`` maps a metric name to its column."""
    # Fixed limits and labels, in order of precedence.
    rules = [
        ((metric("avg_cpu_temp") > 90) | (metric("max_cpu_usage") > 95), "Thermal/CPU Issue"),
        ((metric("avg_memory_utilization") > 90) | (metric("max_memory_usage") > 95), "Memory Pressure"),
        (metric("avg_battery_health") < 60, "Battery Degradation"),
        ((metric("avg_boot_time") > 60) | (metric("p90_boot_time") > 90), "Boot Performance Issue"),
        (metric("uptime_days") > 30, "Needs Restart / Stability Issue"),
        (metric("total_app_crash") > 10, "Application Instability"),
    ]
    label = F.lit("Visit ITSE")
    for condition, name in reversed(rules):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return label


def risk_status(prediction: Column) -> Column:
    """Status text of a 0/1 risk prediction."""
    return F.when(prediction == 1, "HIGH RISK").otherwise("NORMAL")


def confidence_percent(probabilities: Column) -> Column:
    """Largest class probability as a percentage."""
    return F.array_max(probabilities) * 100
