"""From readings to alerts: detect, resolve, mute, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from devicehealth.functions.text import ALL_CLEAR, still_at_risk_body
from devicehealth.operators import alerts, detect
from devicehealth.schema import DISPLAY_THRESHOLDS, alert_dimension


def problem_records(readings: DataFrame, thresholds=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Problematic readings under learned limits, or the shipped ones."""
    return detect.detect(readings, DISPLAY_THRESHOLDS if thresholds is None else thresholds, keep=keep)


def described_alerts(readings: DataFrame, thresholds=None, routing: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One line per user, device and triggered metric.

    ``trigger_threshold`` is the limit that raised the alert, ``display_threshold`` the one its text shows.
    """
    records = problem_records(readings, thresholds, keep)
    lines = alerts.alert_lines(records, alert_dimension(readings.sparkSession), routing)
    limits = DISPLAY_THRESHOLDS if thresholds is None else thresholds
    if isinstance(limits, DataFrame):
        limits = {r["metric"]: r["threshold"] for r in limits.select("metric", "threshold").collect()}
    trigger = F.create_map(*[F.lit(v) for m, t in limits.items() for v in (m, float(t))])[F.col("metric")]
    return lines.withColumnRenamed("threshold", "display_threshold").withColumn("trigger_threshold", trigger)


def messages(readings: DataFrame, directory: DataFrame, opt_outs: DataFrame | None = None, thresholds=None,
             level: str = "user", urls=None) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejects)``: rendered alerts for resolved, unmuted users, and the ones that failed.

    At metric level the muted metrics leave the record before it is rendered.
    """
    records = problem_records(readings, thresholds)
    if opt_outs is not None and level == "user":
        records = alerts.without_muted(records, opt_outs, "user")
    elif opt_outs is not None:
        # A user's opt-outs are at most one row per metric, so the list stays small.
        muted = opt_outs.groupBy("username").agg(
            F.collect_set("metric").alias("_metrics"), F.bool_or(F.col("metric").isNull()).alias("_all"))
        joined = records.join(muted, "username", "left").where(~F.coalesce("_all", F.lit(False)))
        kept = F.map_filter("features", lambda m, _: ~F.array_contains(F.coalesce("_metrics", F.array().cast("array<string>")), m))
        records = joined.withColumn("features", kept).where(F.size("features") > 0).drop("_metrics", "_all")
    sent, rejected = alerts.split_rejects(alerts.resolve_users(records, directory))
    return alerts.render_alerts(sent, urls=urls), rejected


def follow_ups(previous: DataFrame, readings: DataFrame, thresholds=None, order: tuple[str, ...] = ("time",), urls=None) -> DataFrame:
    """Re-diagnosis of alerted users on their latest reading, with the text to show; guides are linked where ``urls`` has them."""
    checked = alerts.rediagnose(previous, readings, lambda latest: problem_records(latest, thresholds), order=order)
    asked = checked.withColumnsRenamed({"remaining": "features"}).withColumn("device", F.lit(""))
    rendered = alerts.render_alerts(asked, urls=urls)
    text = F.when(F.col("status") == "all clear", F.lit(ALL_CLEAR)).otherwise(still_at_risk_body(F.col("items")))
    return rendered.select("username", "status", F.col("features").alias("remaining"), text.alias("text"))
