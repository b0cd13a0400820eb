"""Labels, text and action parsing."""

from pyspark.sql import functions as F

from devicehealth.catalog.joins import IMPORTANCE_SQL, LIMITS_SQL, VALUES_SQL, importances
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.functions import labels, text as tx
from devicehealth.operators import explain, rollup
from devicehealth.operators.ordering import as_of
from devicehealth.schema import BASE_FEATURES, MESSAGE_KEYWORDS

SEVERITY_5 = """case when total_app_crash > 0 and total_app_crash <= 10 then '0-10' when total_app_crash > 10 and total_app_crash <= 50 then '11-50'
    when total_app_crash > 50 and total_app_crash <= 100 then '51-100' when total_app_crash > 100 and total_app_crash <= 500 then '101-500'
    when total_app_crash > 500 then '500+' end"""
SEVERITY_6 = SEVERITY_5.replace("when total_app_crash > 500 then '500+'",
                                "when total_app_crash > 500 and total_app_crash <= 1000 then '501-1000' when total_app_crash > 1000 then '1000+'")


@query("l1_crash_severity", sql=f"with {FLEET_SQL} select reading_id, {SEVERITY_5} as severity from fleet")
def l1(spark, sf):
    return fleet(spark, sf).select("reading_id", labels.crash_severity(F.col("total_app_crash")).alias("severity"))


@query("l2_crash_severity_fine", sql=f"with {FLEET_SQL} select {SEVERITY_6} as severity, count(*) as n from fleet group by 1 having severity is not null")
def l2(spark, sf):
    return rollup.frequency(fleet(spark, sf).select(labels.crash_severity_fine(F.col("total_app_crash")).alias("severity")), "severity")


EDGES = "[0.0, 0.5, 0.75, 0.9, 0.95, 1.0]"


def segment_sql(source, column, keep):
    return f"""edges as (select list_sort(list_distinct(quantile_cont({column}, {EDGES}))) as e from {source}),
    segmented as (select {keep}, {column}, case when {column} is not null then
      'Segment ' || cast(greatest(len(list_filter(e, lambda x: x < {column})), 1) as varchar) end as segment from {source}, edges)"""


@query("l3_quantile_segments", sql=f"""
    with {FLEET_SQL}, {segment_sql('fleet', 'total_app_crash', 'reading_id')} select reading_id, segment from segmented""")
def l3(spark, sf):
    return rollup.crash_segments(fleet(spark, sf).select("reading_id", "total_app_crash")).select("reading_id", "segment")


@query("c11_segment_profile", sql=f"""
    with {FLEET_SQL}, {segment_sql('fleet', 'total_app_crash', 'avg_processor_time, avg_boot_time')}
    select segment, count(*) as size, round(avg(total_app_crash), 6) as total_app_crash_mean, round(avg(avg_processor_time), 6) as avg_processor_time_mean,
      round(avg(avg_boot_time), 6) as avg_boot_time_mean from segmented group by segment""")
def c11(spark, sf):
    metrics = ["total_app_crash", "avg_processor_time", "avg_boot_time"]
    out = rollup.group_profile(rollup.crash_segments(fleet(spark, sf).select(*metrics)), "segment", metrics)
    return out.select("segment", "size", *[F.round(f"{m}_mean", 6).alias(f"{m}_mean") for m in metrics])


@query("l4_high_risk", sql=f"""
    with {FLEET_SQL} select reading_id, cast(total_app_crash >= (select quantile_cont(total_app_crash, 0.9) from fleet) as integer) as high_risk from fleet""")
def l4(spark, sf):
    return rollup.high_risk_label(fleet(spark, sf).select("reading_id", "total_app_crash"), "total_app_crash").select("reading_id", "high_risk")


@query("l5_extreme_flags", sql=f"""
    with {FLEET_SQL}, known as (select * from fleet where avg_boot_time is not null),
    cut as (select {', '.join(f'quantile_cont({m}, 0.9) as q_{m}' for m in BASE_FEATURES)} from known),
    scored as (select reading_id, {' + '.join(f'cast({m} > q_{m} as integer)' for m in BASE_FEATURES)} as risk_score from known, cut)
    select reading_id, risk_score, cast(risk_score > (select quantile_cont(cast(risk_score as double), 0.9) from scored) as integer) as high_risk from scored""")
def l5(spark, sf):
    known = fleet(spark, sf).select("reading_id", *BASE_FEATURES).na.drop(subset=BASE_FEATURES)
    return rollup.extreme_flags(known, BASE_FEATURES).select("reading_id", "risk_score", "high_risk")


@query("l6_diagnosis", sql=f"""
    with {FLEET_SQL} select reading_id, case when avg_cpu_temp > 90 or max_cpu_usage > 95 then 'Thermal/CPU Issue'
      when avg_memory_utilization > 90 or max_memory_usage > 95 then 'Memory Pressure' when avg_battery_health < 60 then 'Battery Degradation'
      when avg_boot_time > 60 or p90_boot_time > 90 then 'Boot Performance Issue' when uptime_days > 30 then 'Needs Restart / Stability Issue'
      when total_app_crash > 10 then 'Application Instability' else 'Visit ITSE' end as issue from fleet""")
def l6(spark, sf):
    return fleet(spark, sf).select("reading_id", labels.diagnosis().alias("issue"))


@query("l7_status_text", sql="""
    select vec_id, case when label >= 5 then 'HIGH RISK' else 'NORMAL' end as status,
      round(list_max(list_transform(embedding, lambda x: cast(x as double))) * 100, 4) as confidence from embeddings""")
def l7(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", labels.risk_status((F.col("label") >= 5).cast("int")).alias("status"),
                       F.round(labels.confidence_percent(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("confidence"))


@query("x3_root_causes", sql=f"""
    with {FLEET_SQL}, {IMPORTANCE_SQL}, {LIMITS_SQL}, {VALUES_SQL},
    raw as (select reading_id, metric, value, greatest(coalesce(value - threshold, 0), 0) * importance as s
      from readings join limits using (metric) join importance using (metric)),
    shared as (select *, 100 * s / sum(s) over (partition by reading_id) as confidence, sum(s) over (partition by reading_id) as total from raw),
    ranked as (select *, row_number() over (partition by reading_id order by confidence desc, metric) as rank from shared where total > 0 and confidence > 0)
    select reading_id, cast(rank as integer) as rank, metric, value, round(confidence, 4) as confidence from ranked where rank <= 5""")
def x3(spark, sf):
    base = fleet(spark, sf)
    out = explain.root_causes(base, ["reading_id"], BASE_FEATURES, importances(base), top=5)
    return out.withColumn("confidence", F.round("confidence", 4))


@query("t1_platform", sql=f"""
    with {FLEET_SQL} select reading_id, case when regexp_matches(lower(model_name), 'hp|windows|elitebook|thinkpad') then 'windows' else 'mac' end as platform from fleet""")
def t1(spark, sf):
    return fleet(spark, sf).select("reading_id", tx.platform_of(F.col("model_name")).alias("platform"))


@query("t2_format_value", sql=f"""
    with {FLEET_SQL} select reading_id, cast(cast(round_even(uptime_days, 0) as bigint) as varchar) as uptime, cast(round_even(p90_cpu_temp, 1) as varchar) as temp,
      cast(cast(round_even(p90_boot_time, 0) as bigint) as varchar) as boot from fleet""")
def t2(spark, sf):
    return fleet(spark, sf).select(
        "reading_id", tx.format_metric(F.col("uptime_days"), F.lit("uptime_days")).alias("uptime"),
        tx.format_metric(F.col("p90_cpu_temp"), F.lit("p90_cpu_temp")).alias("temp"),
        tx.format_metric(F.col("p90_boot_time"), F.lit("p90_boot_time")).alias("boot"))


@query("t3_distance", sql=f"""
    with {FLEET_SQL} select reading_id, round(93.7 - avg_battery_health, 6) as battery, round(abs(avg_memory_utilization - 78.1), 6) as memory from fleet""")
def t3(spark, sf):
    return fleet(spark, sf).select(
        "reading_id", F.round(tx.distance_past_limit(F.col("avg_battery_health"), F.lit(93.7), F.lit(True)), 6).alias("battery"),
        F.round(F.abs(tx.distance_past_limit(F.col("avg_memory_utilization"), F.lit(78.1), F.lit(False))), 6).alias("memory"))


# Whole documents under a heading, a rule, a list line and bold and italic words.
MARKED = ("concat('## ', source, '  ', {nl}, '---', {nl}, '- see *', lang, '* and **', source, '** or __', lang, '__', {nl}, text)")


@query("t7_chat_markup", sql=f"""
    with raw as (select doc_id, {MARKED.format(nl='chr(10)')} as body from documents),
    lines as (select doc_id, list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l:
      case when regexp_matches(l, '^#{{1,3}}\\s+') then '*' || trim(regexp_extract(l, '^#{{1,3}}\\s+(.*)', 1)) || '*'
        when regexp_matches(l, '^\\s*-{{3,}}\\s*$') then ''
        else regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^(\\s*)-\\s+', '\\1• '), '(^|[^*])\\*([^*]+)\\*([^*]|$)', '\\1_\\2_\\3', 'g'),
          '\\*\\*(.+?)\\*\\*', '*\\1*', 'g'), '__(.+?)__', '*\\1*', 'g') end) as ls from raw)
    select doc_id, regexp_replace(array_to_string(ls, chr(10)), '^\\s+|\\s+$', '', 'g') as article from lines""")
def t7(spark, sf):
    marked = table(spark, sf, "documents").selectExpr("doc_id", MARKED.format(nl="'\\n'") + " as body")
    return marked.select("doc_id", tx.chat_markup(F.col("body")).alias("article"))


KEYWORD_SQL = "case " + " ".join(f"when contains(lower(text), '{k}') then '{m}'" for k, m in MESSAGE_KEYWORDS) + " end"


@query("t8_keyword_routing", sql=f"""
    with m as (select doc_id, {KEYWORD_SQL} as matched, source from documents)
    select doc_id, coalesce(matched, case when source <> 'src0' then source end) as metric from m""")
def t8(spark, sf):
    documents = table(spark, sf, "documents")
    last = F.when(F.col("source") != "src0", F.col("source"))
    return documents.select("doc_id", F.coalesce(tx.match_keyword(F.col("text")), last).alias("metric"))


@query("t8_keyword_or_last_alert", sql=f"""
    with messages as (select event_id, user_id, ts, case when event_type = 'view' then 'my laptop is SLOW' when event_type = 'click' then 'low Battery?' else 'hello' end as text
        from events where event_type <> 'error'),
    raised as (select event_id, user_id, ts, case when value > 50 then 'uptime_days' else 'p90_cpu_temp' end as metric from events where event_type = 'error')
    select m.event_id, coalesce({KEYWORD_SQL}, a.metric, 'generic') as metric from messages m asof left join raised a on m.user_id = a.user_id and m.ts >= a.ts""")
def t8_last(spark, sf):
    events = table(spark, sf, "events")
    said = F.when(F.col("event_type") == "view", "my laptop is SLOW").when(F.col("event_type") == "click", "low Battery?").otherwise("hello")
    messages = events.where("event_type <> 'error'").select("event_id", "user_id", "ts", said.alias("text"))
    raised = events.where("event_type = 'error'").select(
        "event_id", "user_id", "ts", F.when(F.col("value") > 50, "uptime_days").otherwise("p90_cpu_temp").alias("metric"))
    matched = as_of(messages, raised, "user_id", "ts", ["metric"], "event_id")
    return matched.select("event_id", F.coalesce(tx.match_keyword(F.col("text")), F.col("metric"), F.lit("generic")).alias("metric"))


@query("t9_device_in_message", sql="""
    with m as (select p_partkey, case when p_size > 25 then 'on your *' || p_name || ' ' || p_type || '-' || cast(p_size as varchar) || '* that' else 'on your *' || p_brand || '* that' end as text from part)
    select p_partkey, coalesce(nullif(regexp_extract(text, '\\*([\\w\\s\\-]+)\\*', 1), ''), 'your device') as device from m""")
def t9(spark, sf):
    named = F.concat(F.lit("on your *"), "p_name", F.lit(" "), "p_type", F.lit("-"), F.col("p_size").cast("string"), F.lit("* that"))
    message = F.when(F.col("p_size") > 25, named).otherwise(F.concat(F.lit("on your *"), "p_brand", F.lit("* that")))
    return table(spark, sf, "part").select("p_partkey", tx.device_in_message(message).alias("device"))


ACTION = ("case event_type when 'click' then concat('opt_out__', 'metric_', cast(user_id as string)) when 'error' then 'opt_out_reason__skip' "
          "when 'view' then 'opt_out_reason__too_many' when 'signup' then 'done_selfservice__uptime_days' else 'snooze' end")


@query("t10_action_parse", sql=f"""
    with a as (select event_id, {ACTION} as action from events),
    p as (select event_id, nullif(regexp_extract(action, '^(opt_out_reason|opt_out|done_selfservice|done_replacement)__(.+)$', 1), '') as kind,
      nullif(regexp_extract(action, '^(opt_out_reason|opt_out|done_selfservice|done_replacement)__(.+)$', 2), '') as argument from a)
    select event_id, kind, case when kind = 'opt_out_reason' and argument = 'skip' then 'no_reason_given' else argument end as argument from p""")
def t10(spark, sf):
    actions = table(spark, sf, "events").selectExpr("event_id", f"{ACTION} as action")
    return actions.select("event_id", tx.action_kind(F.col("action")).alias("kind"), tx.action_argument(F.col("action")).alias("argument"))


@query("t11_decode_key", sql="select page_id, url_decode(replace(url || '/a+b%20c%2Fd', '+', ' ')) as key from pages")
def t11(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.decode_key(F.concat("url", F.lit("/a+b%20c%2Fd"))).alias("key"))


@query("t12_first_name", sql="""
    select c_custkey, coalesce(nullif(case when c_nationkey > 12 then '' when c_nationkey > 6 then null else c_name end, ''), split_part(c_mktsegment || ' Person', ' ', 1)) as first_name
    from customer""")
def t12(spark, sf):
    given = F.when(F.col("c_nationkey") > 12, "").when(F.col("c_nationkey") > 6, F.lit(None)).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", tx.first_name_of(given, F.concat("c_mktsegment", F.lit(" Person"))).alias("first_name"))
