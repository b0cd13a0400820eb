"""Streams run to the end of the given tables; each result equals its batch twin."""

from pyspark.sql import functions as F

from devicehealth.catalog.aggregates import OPT_LOG
from devicehealth.catalog.alerts import HITS_SQL, ORDER
from devicehealth.catalog.registry import ORACLES, query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.schema import ALERT_METRICS, DISPLAY_THRESHOLDS
from devicehealth.session import scratch_path
from devicehealth.sources.side_tables import write_thresholds
from devicehealth.streaming import alerts as sa
from devicehealth.streaming.daily import daily_alerts
from devicehealth.streaming.recent import messages_with_latest_alert

ARRIVING = ["reading_id", "auth_username", "model_name", *[m[0] for m in ALERT_METRICS]]


def uploads(spark, sf):
    """The fleet as headered gzip files, one folder per return status, each with its columns in another order."""
    path = scratch_path(spark, "uploads")
    early = F.coalesce(F.col("uptime_days") < 20, F.lit(False))
    rows = fleet(spark, sf).select(*ARRIVING)
    for name, part, order in (("a", rows.where(early), ARRIVING), ("b", rows.where(~early), ARRIVING[::-1])):
        part.select(*order).write.option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
    return path


def listed(df):
    return df.select("reading_id", "username", "device", F.array_join(F.map_keys("features"), ",").alias("features"))


R1_SQL = f"""with {FLEET_SQL}, {HITS_SQL}
    select reading_id, username, device, string_agg(metric, ',' order by {ORDER}) as features from hits group by reading_id, username, device"""


@query("r1_alert_stream", sql=R1_SQL)
def r1(spark, sf):
    out = scratch_path(spark, "alerts")
    stream = sa.arriving_files(spark, uploads(spark, sf), files_per_batch=4)
    sa.alert_stream(stream, out, scratch_path(spark, "checkpoint"), ARRIVING, keep=("reading_id",)).awaitTermination()
    return listed(spark.read.parquet(out))


@query("r2_reloaded_thresholds", sql=R1_SQL)
def r2(spark, sf):
    out, limits = scratch_path(spark, "alerts"), scratch_path(spark, "thresholds")
    write_thresholds(spark.createDataFrame(list(DISPLAY_THRESHOLDS.items()), "metric string, threshold double"), limits)
    stream = sa.arriving_files(spark, uploads(spark, sf))
    sa.alert_stream(stream, out, scratch_path(spark, "checkpoint"), ARRIVING, thresholds=limits, keep=("reading_id",)).awaitTermination()
    ordered = F.array(*[F.lit(m[0]) for m in ALERT_METRICS])
    return spark.read.parquet(out).select("reading_id", "username", "device", F.array_join(
        F.filter(ordered, lambda m: F.array_contains(F.map_keys("features"), m)), ",").alias("features"))


@query("r3_latest_alert_stream", sql="""
    with m as (select event_id, user_id, ts from events where event_type <> 'error'),
    a as (select user_id, ts, case when value > 50 then 'uptime_days' else 'p90_cpu_temp' end as metric from events where event_type = 'error')
    select m.event_id, m.user_id, m.ts, a.metric, a.ts as alert_ts from m asof left join a on m.user_id = a.user_id and m.ts >= a.ts""")
def r3(spark, sf):
    folder, out = scratch_path(spark, "messages"), scratch_path(spark, "answers")
    alert = F.col("event_type") == "error"
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(alert, "alert").otherwise("message").alias("kind"),
        F.when(alert, F.when(F.col("value") > 50, "uptime_days").otherwise("p90_cpu_temp")).alias("metric"))
    # One file per micro-batch, the alerts first; within both kinds the later days come before the earlier ones.
    cuts = ["2030-01-01", "2024-01-21", "2024-01-11", "2024-01-01"]
    for kind in ("alert", "message"):
        for end, start in zip(cuts, cuts[1:]):
            inside = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
            events.where(inside & (F.col("kind") == kind)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    answered = messages_with_latest_alert(stream)
    answered.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "alert_ts")})


@query("r4_opt_out_stream", sql=ORACLES["a18_opt_out_state"])
def r4(spark, sf):
    folder, log = scratch_path(spark, "optevents"), scratch_path(spark, "optlog")
    table(spark, sf, "events").createOrReplaceTempView("_events")
    events = spark.sql(OPT_LOG.format(events="_events"))
    events.repartition(2, "username").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sa.opt_out_stream(stream, log, scratch_path(spark, "checkpoint")).awaitTermination()
    return sa.current_opt_outs(spark, log)


@query("r1_daily_alerts", sql="select distinct user_id, cast(ts as date) as day from events where event_type = 'error'")
def r1_daily(spark, sf):
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("errors", "daily", "checkpoint"))
    errors = table(spark, sf, "events").where("event_type = 'error'").select("user_id", "ts")
    turn = errors.agg(F.percentile_approx("ts", 0.5)).first()[0]
    half = {True: errors.where(F.col("ts") < F.lit(turn)), False: errors.where(F.col("ts") >= F.lit(turn))}

    def run():
        stream = spark.readStream.schema(errors.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        daily_alerts(stream, "user_id").select("user_id", "day").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()

    # The earlier half, once more the same, a restart, then the later half and a part of it again.
    for rows in (half[True], half[True]):
        rows.coalesce(1).write.mode("append").parquet(folder)
    run()
    for rows in (half[False], half[False].where("user_id % 2 = 0")):
        rows.coalesce(1).write.mode("append").parquet(folder)
    run()
    return spark.read.parquet(out)
