"""Telemetry columns, metric presets and the alert dimension.

Everything here is a fixed value: column order of the raw files, feature lists,
limits, labels and message templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

TELEMETRY_COLUMNS = (
    "karl_id host_name model_name hardware_make karl_last_seen auth_username serial_number group_id "
    "tenant_id platform metric_category measure_name time p90_processor_time avg_processor_time "
    "max_cpu_usage p90_memory_utilization avg_memory_utilization max_memory_usage p10_battery_health "
    "avg_battery_health cpu_count memory_count memory_size_gb driver_vendor os wifi_mac_add "
    "driver_version driver_date os_version driver agent_id performance_status device_status "
    "max_battery_temperature avg_battery_temperature p90_battery_temperature avg_cpu_temp p90_cpu_temp "
    "avg_battery_discharge p90_battery_discharge avg_boot_time p90_boot_time uptime_days total_app_crash"
).split()

NUMERIC_METRICS = (
    "p90_processor_time avg_processor_time max_cpu_usage p90_memory_utilization avg_memory_utilization "
    "max_memory_usage p10_battery_health avg_battery_health cpu_count memory_count memory_size_gb "
    "max_battery_temperature avg_battery_temperature p90_battery_temperature avg_cpu_temp p90_cpu_temp "
    "avg_battery_discharge p90_battery_discharge avg_boot_time p90_boot_time uptime_days total_app_crash"
).split()

TELEMETRY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TELEMETRY_COLUMNS])

# Predictors shared by the crash and risk models.
BASE_FEATURES = (
    "avg_processor_time max_cpu_usage avg_memory_utilization max_memory_usage avg_battery_health "
    "cpu_count memory_size_gb avg_cpu_temp avg_boot_time p90_boot_time uptime_days"
).split()

CRASHES = "total_app_crash"
DIAGNOSIS_FEATURES = BASE_FEATURES + [CRASHES]

# Metrics whose alert limits are learned from a response curve.
THRESHOLD_FEATURES = (
    "avg_processor_time max_cpu_usage avg_memory_utilization avg_battery_health uptime_days p90_cpu_temp"
).split()

# Zero-based position of the response-curve spike taken as the limit of each metric.
SPIKE_POSITION = {
    "avg_processor_time": 4,
    "max_cpu_usage": 4,
    "avg_memory_utilization": 4,
    "avg_battery_health": 2,
    "uptime_days": 3,
    "p90_cpu_temp": 4,
}

# Host averages used for clustering, crashes first.
HOST_METRICS = (
    "total_app_crash avg_processor_time avg_memory_utilization avg_cpu_temp avg_boot_time uptime_days "
    "max_cpu_usage max_memory_usage"
).split()

# Host averages of the crash overview; crashes themselves get sum, mean, max and count.
OVERVIEW_METRICS = (
    "avg_processor_time avg_memory_utilization avg_battery_health avg_cpu_temp avg_boot_time uptime_days "
    "max_cpu_usage max_memory_usage"
).split()

MODEL_METRICS = ["p90_processor_time"] + BASE_FEATURES + [CRASHES]

# Predictors left out of a per-metric model besides the target itself.
MODEL_EXCLUSIONS = {
    "total_app_crash": ["p90_processor_time"],
    "uptime_days": ["p90_processor_time"],
    "avg_memory_utilization": ["avg_processor_time"],
    "max_cpu_usage": ["p90_processor_time"],
}
# Models trained on positive targets only.
POSITIVE_TARGETS = ("total_app_crash", "uptime_days")
MODEL_TARGETS = (
    "total_app_crash uptime_days avg_battery_health avg_boot_time avg_cpu_temp avg_memory_utilization "
    "avg_processor_time cpu_count max_cpu_usage max_memory_usage memory_size_gb p90_processor_time"
).split()


def predictors_of(target: str) -> list[str]:
    """Predictor columns of the per-metric model for ``target``."""
    left_out = {target, *MODEL_EXCLUSIONS.get(target, [])}
    return [m for m in MODEL_METRICS if m not in left_out]


# Alert dimension: metric, label, button label, display limit, lower is worse, type, headline, delta line, unit.
ALERT_METRICS = [
    ("avg_processor_time", "Processor Time", "Check Processor Performance", 67.6, False, "replacement",
     "CPU taking around {value} ns to process tasks", "{delta} ns over the recommended threshold", "ns"),
    ("max_cpu_usage", "Max CPU Usage", "Reduce CPU Load (3 min)", 90.2, False, "self-service",
     "CPU working {value}% of the time", "{delta}% over the recommended threshold", "%"),
    ("avg_memory_utilization", "Average Memory Utilization", "Reduce Memory Usage (3 min)", 78.1, False,
     "self-service", "Memory at {value}%", "{delta}% over the recommended threshold", "%"),
    ("avg_battery_health", "Battery Health", "Check Battery Health", 93.7, True, "replacement",
     "Battery at {value}% of its service life", "{delta}% over the recommended threshold", "%"),
    ("uptime_days", "System Uptime", "Restart your Laptop (2 min)", 27.0, False, "self-service",
     "No restart in {value} days", "{delta} days over the recommended threshold", "days"),
    ("p90_cpu_temp", "CPU Temperature", "Cool Down your Laptop", 88.1, False, "self-service",
     "CPU temperature at {value}°F", "{delta} degrees over the recommended threshold", "°F"),
]
ALERT_DIMENSION_SCHEMA = (
    "metric string, label string, button_label string, threshold double, lower_is_worse boolean, "
    "type string, headline string, delta_line string, unit string"
)
DISPLAY_THRESHOLDS = {m[0]: m[3] for m in ALERT_METRICS}
LOWER_IS_WORSE = {m[0] for m in ALERT_METRICS if m[4]}
ONE_DECIMAL_METRICS = ("p90_cpu_temp",)


def alert_dimension(spark: SparkSession) -> DataFrame:
    """The six alert metrics as a DataFrame; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(ALERT_METRICS, ALERT_DIMENSION_SCHEMA)


# Keyword -> metric, first hit wins. Callers may pass their own list.
MESSAGE_KEYWORDS = [
    ("memory", "avg_memory_utilization"),
    ("ram", "avg_memory_utilization"),
    ("slow", "avg_boot_time"),
    ("startup", "avg_boot_time"),
    ("boot", "avg_boot_time"),
    ("performance", "max_memory_pressure"),
    ("pressure", "max_memory_pressure"),
    ("cpu", "cpu_count"),
    ("processor", "cpu_count"),
    ("battery", "battery_cycle"),
    ("charge", "battery_cycle"),
]

# Device-name fragments that mean a Windows machine.
WINDOWS_NAMES = ("hp", "windows", "elitebook", "thinkpad")

CRASH_BINS_5 = ([0, 10, 50, 100, 500, float("inf")], ["0-10", "11-50", "51-100", "101-500", "500+"])
CRASH_BINS_6 = (
    [0, 10, 50, 100, 500, 1000, float("inf")],
    ["0-10", "11-50", "51-100", "101-500", "501-1000", "1000+"],
)
SEGMENT_PERCENTILES = [0.0, 0.5, 0.75, 0.9, 0.95, 1.0]
EXTREME_HOST_CRASHES = 7000.0
