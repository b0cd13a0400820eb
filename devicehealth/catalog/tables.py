"""The shared tables, and the fleet view that stands in for telemetry.

The stand-in is written once as SQL expressions valid in Spark and in the checking engine, so both
sides start from the same readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from devicehealth.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One reading per order line: supplier = host, part = user, return flag = device model.
FLEET = {
    "reading_id": "concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string), '-', cast(cast(l_quantity as int) as string))",
    "host_name": "concat('host-', cast(l_suppkey as string))",
    "auth_username": "case when l_linenumber = 7 and l_quantity < 3 then '' else concat('user', cast(l_partkey as string)) end",
    "model_name": "case when l_returnflag = 'A' then 'HP EliteBook 840' when l_returnflag = 'N' then 'MacBook Pro 14' when l_tax = 0.08 and l_quantity = 50 then null else 'ThinkPad T14' end",
    "time": "l_shipdate",
    "p90_processor_time": "l_quantity * 2 + l_tax * 100",
    "avg_processor_time": "l_quantity * 2",
    "max_cpu_usage": "60 + l_tax * 500",
    "avg_memory_utilization": "l_discount * 1000",
    "max_memory_usage": "l_discount * 900 + l_tax * 125",
    "avg_battery_health": "100 - l_linenumber * 2 - l_tax * 500",
    "cpu_count": "cast(4 + l_linenumber as double)",
    "memory_size_gb": "cast(8 * l_linenumber as double)",
    "avg_cpu_temp": "40 + l_quantity",
    "p90_cpu_temp": "45 + l_quantity",
    "avg_boot_time": "case when l_quantity = 13 then null else l_extendedprice / 1000 end",
    "p90_boot_time": "l_extendedprice / 800",
    "uptime_days": "cast(l_linenumber * 5 as double)",
    "total_app_crash": "case when l_linenumber = 1 and l_quantity < 5 then 0 else floor(l_extendedprice / 80) end",
}


def _fleet_columns(names) -> list[str]:
    return [f"cast({FLEET[n]} as double) as {n}" if n not in
            ("reading_id", "host_name", "auth_username", "model_name", "time") else f"{FLEET[n]} as {n}" for n in names]


FLEET_SQL = f"fleet as (select {', '.join(_fleet_columns(FLEET))} from lineitem)"


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the stand-in fleet."""
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*_fleet_columns(FLEET))


USER_METRICS = ["click", "error", "purchase", "signup", "view"]
USERS_SQL = "users as (select user_id, " + ", ".join(
    f"avg(case when event_type = '{m}' then value end) as {m}" for m in USER_METRICS) + " from events group by user_id)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per user and event type: a small host table."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").pivot("event_type", USER_METRICS).avg("value")


# Standardised user metrics, population deviation.
SCALED_USERS_SQL = USERS_SQL + ", scaled as (select user_id, " + ", ".join(
    f"({m} - avg({m}) over ()) / stddev_pop({m}) over () as {m}" for m in USER_METRICS) + " from users where " + " and ".join(
    f"{m} is not null" for m in USER_METRICS) + ")"
