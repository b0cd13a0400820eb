"""Projections and cleaning."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.functions.numeric import percent_difference, round_half_even, to_number, to_time
from devicehealth.operators.clean import coerce_numeric, complete_cases, long_metrics, strip_zone
from devicehealth.operators.rollup import host_overview

# Readings as text with the dirt that raw files hold.
DIRTY = ("case when l_linenumber = 1 and l_quantity < 9 then 'bad' when l_linenumber = 2 and l_quantity < 9 then '' "
         "when l_linenumber = 3 and l_quantity < 9 then 'NaN' when l_linenumber = 4 and l_quantity < 9 then 'inf' "
         "when l_linenumber = 5 and l_quantity < 9 then '1f' when l_linenumber = 6 and l_quantity < 9 then ' 5 ' "
         "when l_linenumber = 7 and l_quantity < 9 then '1e3' else cast(l_partkey as string) end")
IDS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("p1_coerce_numeric", sql=f"""
    with raw as (select {IDS}, {DIRTY} as v from lineitem)
    select {IDS}, case when regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                       then try_cast(trim(v) as double) end as v from raw""")
def p1(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(*IDS.split(", "), f"{DIRTY} as v")
    return coerce_numeric(raw, ["v"])


TIME_TEXT = ("case when l_linenumber = 1 then 'not a date' when l_linenumber = 2 then '' "
             "else substr(cast(l_shipdate as string), 1, 10) end")


@query("p2_coerce_timestamp", sql=f"""
    with raw as (select {IDS}, {TIME_TEXT} as t from lineitem) select {IDS}, try_cast(t as timestamp) as t from raw""")
def p2(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(*IDS.split(", "), f"{TIME_TEXT} as t")
    return raw.withColumn("t", to_time(F.col("t")).cast("timestamp_ntz"))


@query("p3_strip_zone", sql="select event_id, ts from events")
def p3(spark, sf):
    zoned = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return strip_zone(zoned, "ts")


@query("p4_select_features", sql=f"with {FLEET_SQL} select avg_processor_time, uptime_days, total_app_crash, host_name from fleet")
def p4(spark, sf):
    return fleet(spark, sf).select("avg_processor_time", "max_cpu_usage", "uptime_days", "total_app_crash", "host_name").drop("max_cpu_usage")


@query("p5_complete_cases", sql=f"""
    with {FLEET_SQL} select reading_id, avg_boot_time, model_name from fleet
    where avg_boot_time is not null and model_name is not null""")
def p5(spark, sf):
    return complete_cases(fleet(spark, sf).select("reading_id", "avg_boot_time", "model_name"), ["avg_boot_time", "model_name"])


@query("p6_named_aggregates", sql=f"""
    with {FLEET_SQL} select host_name, coalesce(sum(total_app_crash), 0) as total_app_crash_sum,
      round(avg(total_app_crash), 6) as total_app_crash_mean, max(total_app_crash) as total_app_crash_max,
      count(total_app_crash) as total_app_crash_count, round(avg(avg_boot_time), 6) as avg_boot_time_mean
    from fleet group by host_name""")
def p6(spark, sf):
    out = host_overview(fleet(spark, sf), metrics=["avg_boot_time"])
    return out.withColumns({c: F.round(c, 6) for c in ("total_app_crash_mean", "avg_boot_time_mean")})


@query("p7_round_half_even", sql=f"""
    select {IDS}, round_even(l_quantity / 2, 0) as half, round_even(l_quantity / 8, 2) as eighth from lineitem""")
def p7(spark, sf):
    return table(spark, sf, "lineitem").select(*IDS.split(", "), round_half_even(F.col("l_quantity") / 2, 0).alias("half"),
                                               round_half_even(F.col("l_quantity") / 8, 2).alias("eighth"))


@query("p8_percent_difference", sql=f"""
    select {IDS}, case when l_tax = 0 then null else (l_discount - l_tax) / l_tax * 100 end as diff from lineitem""")
def p8(spark, sf):
    return table(spark, sf, "lineitem").select(*IDS.split(", "), percent_difference(F.col("l_discount"), F.col("l_tax")).alias("diff"))


@query("p9_flag", sql=f"select {IDS}, cast(l_quantity > 45 as integer) as high from lineitem")
def p9(spark, sf):
    return table(spark, sf, "lineitem").select(*IDS.split(", "), (F.col("l_quantity") > 45).cast("int").alias("high"))


@query("p10_long_metrics", sql=f"""
    with {FLEET_SQL} select reading_id, 'uptime_days' as metric, uptime_days as value from fleet
    union all select reading_id, 'avg_boot_time', avg_boot_time from fleet
    union all select reading_id, 'max_cpu_usage', max_cpu_usage from fleet""")
def p10(spark, sf):
    return long_metrics(fleet(spark, sf), ["reading_id"], ["uptime_days", "avg_boot_time", "max_cpu_usage"])


@query("n1_number_guard", sql=f"""
    with raw as (select {DIRTY} as v from lineitem)
    select v, count(*) as n, cast(sum(case when regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') then 1 else 0 end) as bigint) as numbers
    from raw group by v""")
def n1(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(f"{DIRTY} as v")
    return raw.groupBy("v").agg(F.count("*").alias("n"), F.count(to_number(F.col("v"))).alias("numbers"))
