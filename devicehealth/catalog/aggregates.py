"""Roll-ups, quantiles and distributions."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import rollup
from devicehealth.operators.alerts import opt_out_state
from devicehealth.operators.quantiles import at_or_above_quantile, quantiles
from devicehealth.schema import BASE_FEATURES, HOST_METRICS, OVERVIEW_METRICS, THRESHOLD_FEATURES


def rounded(df, digits=6, skip=()):
    """Round every double, so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def sql_means(metrics, digits=6, suffix=""):
    return ", ".join(f"round(avg({m}), {digits}) as {m}{suffix}" for m in metrics)


@query("a1_host_means", sql=f"""
    with {FLEET_SQL} select host_name, {sql_means(HOST_METRICS)} from fleet group by host_name""")
def a1(spark, sf):
    return rounded(rollup.host_means(fleet(spark, sf)))


@query("a2_host_overview", sql=f"""
    with {FLEET_SQL} select host_name, coalesce(sum(total_app_crash), 0) as total_app_crash_sum,
      round(avg(total_app_crash), 6) as total_app_crash_mean, max(total_app_crash) as total_app_crash_max,
      count(total_app_crash) as total_app_crash_count, {sql_means(OVERVIEW_METRICS, suffix='_mean')}
    from fleet group by host_name""")
def a2(spark, sf):
    return rounded(rollup.host_overview(fleet(spark, sf)))


REPORT_SQL = f"""with {FLEET_SQL}, report as (
    select host_name, round_even(avg(total_app_crash), 2) as avg_crashes, round_even(coalesce(sum(total_app_crash), 0), 2) as total_crashes,
      count(total_app_crash) as record_count, round_even(max(total_app_crash), 2) as max_crashes,
      round_even(avg(avg_processor_time), 2) as avg_cpu, round_even(avg(avg_memory_utilization), 2) as avg_memory,
      round_even(avg(avg_cpu_temp), 2) as avg_temp, round_even(avg(avg_boot_time), 2) as avg_boot,
      round_even(avg(uptime_days), 2) as avg_uptime
    from fleet group by host_name)"""


@query("a2_host_crash_report", sql=f"{REPORT_SQL} select * from report")
def a2_report(spark, sf):
    return rollup.host_crash_report(fleet(spark, sf))


@query("f3_extreme_hosts", sql=f"{REPORT_SQL} select * from report where avg_crashes > 660")
def f3(spark, sf):
    return rollup.extreme_hosts(rollup.host_crash_report(fleet(spark, sf)), above=660.0)


@query("w4_top_hosts", sql=f"{REPORT_SQL} select * from report order by avg_crashes desc, host_name limit 20")
def w4(spark, sf):
    return rollup.host_crash_report(fleet(spark, sf)).orderBy(F.desc("avg_crashes"), "host_name").limit(20)


@query("a3_frequency", sql="select event_type, count(*) as n from events where event_type is not null group by event_type")
def a3(spark, sf):
    return rollup.frequency(table(spark, sf, "events"), "event_type")


@query("a4_most_frequent", sql=f"""
    with {FLEET_SQL} select total_app_crash, count(*) as n from fleet group by total_app_crash order by n desc, total_app_crash limit 20""")
def a4(spark, sf):
    return rollup.most_frequent(fleet(spark, sf), "total_app_crash", 20)


DESCRIBED = ["total_app_crash", "avg_boot_time", "avg_processor_time"]


@query("a5_describe", sql=f"with {FLEET_SQL} " + " union all ".join(
    f"""select '{m}' as metric, count({m}) as count, round(avg({m}), 6) as mean, round(stddev_samp({m}), 6) as std, round(min({m}), 6) as min,
    round(quantile_cont({m}, 0.25), 6) as p25, round(quantile_cont({m}, 0.5), 6) as p50, round(quantile_cont({m}, 0.75), 6) as p75,
    round(max({m}), 6) as max from fleet""" for m in DESCRIBED))
def a5(spark, sf):
    return rounded(rollup.describe(fleet(spark, sf), DESCRIBED))


@query("a6_exact_quantiles", sql=f"with {FLEET_SQL} " + " union all ".join(
    f"select cast({p} as double) as prob, round(quantile_cont(total_app_crash, {p}), 6) as value from fleet"
    for p in (0.0, 0.5, 0.75, 0.9, 0.95, 1.0)))
def a6(spark, sf):
    return rounded(quantiles(fleet(spark, sf), ["total_app_crash"], [0.0, 0.5, 0.75, 0.9, 0.95, 1.0]).drop("metric"))


@query("a6_quantiles_per_group", sql=f"""
    with {FLEET_SQL} select host_name, 'avg_boot_time' as metric, cast(0.9 as double) as prob,
      round(quantile_cont(avg_boot_time, 0.9), 6) as value from fleet group by host_name""")
def a6_grouped(spark, sf):
    return rounded(quantiles(fleet(spark, sf), ["avg_boot_time"], [0.9], by=["host_name"]))


@query("a7_matrix_quantile", sql=f"with {FLEET_SQL} " + " union all ".join(
    f"select '{m}' as metric, round(quantile_cont({m}, 0.9), 6) as value from fleet" for m in BASE_FEATURES))
def a7(spark, sf):
    return rounded(quantiles(fleet(spark, sf), BASE_FEATURES, [0.9]).drop("prob"))


PROFILE = ["total_app_crash", "avg_processor_time", "avg_memory_utilization", "avg_boot_time"]


@query("a8_group_profile", sql=f"""
    with {FLEET_SQL} select model_name, count(*) as size, {sql_means(PROFILE, suffix='_mean')} from fleet
    where model_name is not null group by model_name""")
def a8(spark, sf):
    return rounded(rollup.group_profile(fleet(spark, sf), "model_name", PROFILE))


@query("a9_ranked_means", sql=f"""
    with {FLEET_SQL} select cpu_count, round(avg(total_app_crash), 6) as mean from fleet group by cpu_count order by mean desc""")
def a9(spark, sf):
    return rounded(rollup.ranked_means(fleet(spark, sf), "cpu_count", "total_app_crash"), skip=("cpu_count",))


CORR = ["avg_processor_time", "avg_memory_utilization", "p90_boot_time", "total_app_crash"]


@query("a10_correlation", sql=f"with {FLEET_SQL} " + " union all ".join(
    f"select '{a}' as \"left\", '{b}' as \"right\", " + ("cast(1 as double)" if a == b else f"round(corr({a}, {b}), 8)") + " as corr from fleet"
    + (" limit 1" if a == b else "") if a != b else f"select '{a}' as \"left\", '{b}' as \"right\", cast(1 as double) as corr"
    for a in CORR for b in CORR))
def a10(spark, sf):
    return rounded(rollup.correlation_matrix(fleet(spark, sf), CORR), 8)


HIGH_SQL = f"""with {FLEET_SQL}, cut as (select quantile_cont(total_app_crash, 0.9) as t from fleet),
    marked as (select fleet.*, cast(total_app_crash >= t as integer) as high_risk from fleet, cut)"""


@query("a11_class_balance", sql=f"""{HIGH_SQL}
    select count(high_risk) as rows, cast(sum(high_risk) as bigint) as positives, round(avg(high_risk), 6) as rate from marked""")
def a11(spark, sf):
    return rounded(rollup.class_balance(rollup.high_risk_label(fleet(spark, sf), "total_app_crash"), "high_risk"))


@query("a12_class_contrast", sql=f"""{HIGH_SQL}, long as (""" + " union all ".join(
    f"select '{m}' as metric, avg(case when high_risk = 1 then {m} end) as high, avg(case when high_risk = 0 then {m} end) as low from marked"
    for m in BASE_FEATURES) + """)
    select metric, round(high, 6) as high, round(low, 6) as low,
      round(case when low = 0 then null else (high - low) / low * 100 end, 4) as percent_difference from long""")
def a12(spark, sf):
    out = rollup.class_contrast(rollup.high_risk_label(fleet(spark, sf), "total_app_crash"), "high_risk", BASE_FEATURES)
    return out.select("metric", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"),
                      F.round("percent_difference", 4).alias("percent_difference"))


@query("a13_sizes", sql="select count(*) as rows, count(distinct user_id) as keys from events")
def a13(spark, sf):
    return rollup.sizes(table(spark, sf, "events"), "user_id")


@query("a14_medians", sql=f"with {FLEET_SQL} " + " union all ".join(
    f"select '{m}' as metric, round(min({m}), 6) as min, round(max({m}), 6) as max, round(quantile_cont({m}, 0.5), 6) as median from fleet"
    for m in THRESHOLD_FEATURES))
def a14(spark, sf):
    return rounded(rollup.medians_and_ranges(fleet(spark, sf), THRESHOLD_FEATURES))


@query("a15_histogram", sql="""
    with ends as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
    binned as (select least(cast(floor((l_extendedprice - lo) / (hi - lo) * 50) as integer), 49) as bin, lo, hi from lineitem, ends)
    select bin, round(lo + (hi - lo) * bin / 50, 6) as edge, count(*) as n from binned group by bin, lo, hi""")
def a15(spark, sf):
    return rounded(rollup.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50))


@query("a16_high_risk_summary", sql=f"""
    with {FLEET_SQL}, cut as (select quantile_cont(total_app_crash, 0.9) as t from fleet)
    select round(t, 6) as threshold, count(*) as size, round(avg(avg_processor_time), 6) as avg_processor_time_mean,
      round(avg(avg_memory_utilization), 6) as avg_memory_utilization_mean, round(avg(avg_boot_time), 6) as avg_boot_time_mean
    from fleet, cut where total_app_crash >= t group by t""")
def a16(spark, sf):
    return rounded(rollup.high_risk_summary(fleet(spark, sf), "total_app_crash",
                                            ["avg_processor_time", "avg_memory_utilization", "avg_boot_time"]))


@query("a17_mean_score", sql="select label, round(avg(list_avg(embedding)), 6) as mean_score from embeddings group by label")
def a17(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.round(F.avg(total / F.size("embedding")), 6).alias("mean_score"))


# Opt-out log: an error event mutes the metric in its props, a signup event mutes the whole user.
OPT_LOG = ("select concat('user', cast(user_id as string)) as username, "
           "case when event_type = 'error' then concat('m', cast(cast(floor(value / 20) as int) as string)) end as metric, "
           "case when event_type = 'signup' then concat('r', cast(cast(floor(value / 20) as int) as string)) end as reason, "
           "ts, event_id as seq from {events} where event_type in ('error', 'signup')")


@query("a18_opt_out_state", sql=f"""
    with log as ({OPT_LOG.format(events='events')}),
    last as (select username, max(case when reason is not null then seq end) as reason_at,
       arg_max(reason, seq) filter (where reason is not null) as last_reason, max(case when reason is null then seq end) as metric_at
       from log group by username)
    select username, cast(null as varchar) as metric, last_reason as reason from last
      where reason_at is not null and (metric_at is null or reason_at > metric_at)
    union all
    select distinct log.username, log.metric, cast(null as varchar) from log join last using (username)
      where log.reason is null and (reason_at is null or (metric_at > reason_at and log.seq > reason_at))""")
def a18(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("_events")
    return opt_out_state(spark.sql(OPT_LOG.format(events="_events")))


@query("f2_at_or_above_quantile", sql=f"""
    with {FLEET_SQL} select reading_id, total_app_crash from fleet
    where total_app_crash >= (select quantile_cont(total_app_crash, 0.9) from fleet)""")
def f2(spark, sf):
    return at_or_above_quantile(fleet(spark, sf).select("reading_id", "total_app_crash"), "total_app_crash", 0.9)


@query("x4_recommendation_limits", sql=f"""{HIGH_SQL}
    select round(avg(avg_processor_time), 6) as watch_avg_processor_time, round(avg(avg_memory_utilization), 6) as watch_avg_memory_utilization,
      round(avg(avg_boot_time), 6) as watch_avg_boot_time from marked where high_risk = 1""")
def x4(spark, sf):
    return rounded(rollup.recommendation_limits(rollup.high_risk_label(fleet(spark, sf), "total_app_crash"), "high_risk"))
