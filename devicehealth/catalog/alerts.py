"""Detection and alerts."""

from pyspark.sql import functions as F

from devicehealth.catalog.joins import DIMENSION_SQL, LONG_SQL
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.functions import text as tx
from devicehealth.operators import alerts as al
from devicehealth.operators.detect import feature_lines, metric_keys
from devicehealth.plans import alerting
from devicehealth.schema import ALERT_METRICS, alert_dimension
from devicehealth.session import scratch_path
from devicehealth.sources.side_tables import problem_envelopes, problem_records_json, read_problem_envelopes, threshold_map

HITS_SQL = f"""{DIMENSION_SQL}, {LONG_SQL}, hits as (select reading_id, auth_username as username, model_name as device, long.metric, value,
      threshold, lower_is_worse, label, button_label, type, headline, delta_line
    from long join dimension on long.metric = dimension.metric
    where auth_username <> '' and model_name <> '' and case when lower_is_worse then value < threshold else value > threshold end)"""
ORDER = "case metric " + " ".join(f"when '{m[0]}' then {i}" for i, m in enumerate(ALERT_METRICS)) + " end"


def records(spark, sf, keep=("reading_id",)):
    return alerting.problem_records(fleet(spark, sf), keep=keep)


@query("d1_detect", sql=f"""with {FLEET_SQL}, {HITS_SQL}
    select reading_id, username, device, string_agg(metric || '=' || cast(round(value, 4) as varchar), ';' order by {ORDER}) as features
    from hits group by reading_id, username, device""")
def d1(spark, sf):
    listed = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("string"))), ";")
    return records(spark, sf).select("reading_id", "username", "device", listed.alias("features"))


@query("d1_feature_keys", sql=f"""with {FLEET_SQL}, {HITS_SQL}
    select reading_id, string_agg(metric, ',' order by {ORDER}) as features from hits group by reading_id""")
def d1_keys(spark, sf):
    return records(spark, sf).select("reading_id", F.array_join(metric_keys(F.col("features")), ",").alias("features"))


DELTA = "abs(case when lower_is_worse then threshold - value else value - threshold end)"
FORMAT = "case when metric = 'p90_cpu_temp' then cast(round_even({0}, 1) as varchar) else cast(cast(round_even({0}, 0) as bigint) as varchar) end"


@query("d2_alert_lines", sql=f"""with {FLEET_SQL}, {HITS_SQL}
    select reading_id, username, device, metric, label, button_label, type, round(value, 4) as value, threshold as display_threshold,
      threshold as trigger_threshold, round({DELTA}, 4) as delta, {FORMAT.format('value')} as value_text,
      case when regexp_matches(lower(device), 'hp|windows|elitebook|thinkpad') then 'windows' else 'mac' end as platform from hits""")
def d2(spark, sf):
    lines = alerting.described_alerts(fleet(spark, sf), keep=("reading_id",))
    return lines.select("reading_id", "username", "device", "metric", "label", "button_label", "type", F.round("value", 4).alias("value"),
                        "display_threshold", "trigger_threshold", F.round("delta", 4).alias("delta"), "value_text", "platform")


ITEM = (f"'> *' || replace(headline, '{{value}}', {FORMAT.format('value')}) || '*' || chr(10) || '> ' || "
        f"replace(delta_line, '{{delta}}', {FORMAT.format(DELTA)}) || chr(10) || '> ' || button_label")
BODY = ("'Hey ' || username || ' 👋' || chr(10) || chr(10) || 'We noticed a few things on your *' || device || "
        "'* that could cause problems if left unaddressed:' || chr(10) || chr(10) || items || chr(10) || chr(10) || "
        "'Once you''ve followed the steps in the canvas, re-run our diagnosis to see if the risk factors are addressed.'")
RENDERED_SQL = f"""rendered as (select reading_id, username, device, string_agg({ITEM}, chr(10) || chr(10) order by {ORDER}) as items,
    string_agg(label, ', ' order by {ORDER}) as labels, bool_or(type = 'replacement') as replaces from hits group by reading_id, username, device)"""


@query("t4_rendered_alerts", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {RENDERED_SQL} select reading_id, {BODY} as body from rendered""")
def t4(spark, sf):
    return al.render_alerts(records(spark, sf)).select("reading_id", "body")


@query("t5_alert_summary", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {RENDERED_SQL}
    select reading_id, 'Laptop health alert for ' || device || ': ' || labels as summary from rendered""")
def t5(spark, sf):
    return al.render_alerts(records(spark, sf)).select("reading_id", "summary")


@query("t6_alert_class", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {RENDERED_SQL}
    select case when replaces then 'queue' else 'self-service' end as alert_class, count(*) as n from rendered group by 1""")
def t6(spark, sf):
    return al.render_alerts(records(spark, sf)).groupBy("alert_class").agg(F.count("*").alias("n"))


@query("d4_rediagnosis", sql=f"""with {FLEET_SQL}, {HITS_SQL},
    latest as (select * from fleet qualify row_number() over (partition by auth_username order by time desc, reading_id desc) = 1),
    now as (select username, string_agg(metric, ',' order by {ORDER}) as remaining from hits where reading_id in (select reading_id from latest) group by username)
    select username, remaining, case when remaining is null then 'all clear' else 'still at risk' end as status
    from (select distinct username from hits) left join now using (username)""")
def d4(spark, sf):
    readings = fleet(spark, sf)
    checked = al.rediagnose(records(spark, sf), readings, alerting.problem_records, order=("time", "reading_id"))
    return checked.select("username", F.array_join(F.map_keys("remaining"), ",").alias("remaining"), "status")


@query("d4_follow_up_text", sql=f"""with {FLEET_SQL}, {HITS_SQL},
    latest as (select * from fleet qualify row_number() over (partition by auth_username order by time desc, reading_id desc) = 1),
    now as (select username, string_agg({ITEM}, chr(10) || chr(10) order by {ORDER}) as items from hits
      where reading_id in (select reading_id from latest) group by username)
    select username, case when items is null then 'Your laptop is all clear! No risk factors detected. 🎉' else
      'Your laptop is still at risk. Please follow these guides:' || chr(10) || chr(10) || items || chr(10) || chr(10)
      || 'When you''re done, hit *re-run diagnosis* again.' end as text
    from (select distinct username from hits) left join now using (username)""")
def d4_text(spark, sf):
    return alerting.follow_ups(records(spark, sf), fleet(spark, sf), order=("time", "reading_id")).select("username", "text")


def routed(spark, sf):
    """A routing table from the nations: each metric in turn, some nations without an address."""
    names = F.array(*[F.lit(m[0]) for m in ALERT_METRICS])
    url = F.when(F.col("n_nationkey") % 6 != 2, F.concat(F.lit("https://docs.example/"), F.lower("n_name")))
    return table(spark, sf, "nation").select(names[(F.col("n_nationkey") % 6).cast("int")].alias("metric_key"), url.alias("canvas_url"))


ROUTED_SQL = "routed as (select case n_nationkey % 6 " + " ".join(f"when {i} then '{m[0]}'" for i, m in enumerate(ALERT_METRICS)) + (
    " end as metric, min(case when n_nationkey % 6 <> 2 then 'https://docs.example/' || lower(n_name) end) as url from nation group by 1)")
LINKED_ITEM = ITEM.removesuffix("button_label") + "case when url is null then button_label else '<' || url || '|' || button_label || '>' end"


@query("t4_linked_alerts", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {ROUTED_SQL}, {RENDERED_SQL.replace(ITEM, LINKED_ITEM).replace("from hits", "from hits left join routed using (metric)")}
    select reading_id, {BODY} as body from rendered""")
def t4_linked(spark, sf):
    return al.render_alerts(records(spark, sf), urls=al.addresses(routed(spark, sf))).select("reading_id", "body")


@query("d4_linked_follow_up", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {ROUTED_SQL},
    latest as (select * from fleet qualify row_number() over (partition by auth_username order by time desc, reading_id desc) = 1),
    now as (select username, string_agg({LINKED_ITEM}, chr(10) || chr(10) order by {ORDER}) as items from hits left join routed using (metric)
      where reading_id in (select reading_id from latest) group by username)
    select username, case when items is null then 'Your laptop is all clear! No risk factors detected. 🎉' else
      'Your laptop is still at risk. Please follow these guides:' || chr(10) || chr(10) || items || chr(10) || chr(10)
      || 'When you''re done, hit *re-run diagnosis* again.' end as text
    from (select distinct username from hits) left join now using (username)""")
def d4_linked(spark, sf):
    urls = al.addresses(routed(spark, sf))
    return alerting.follow_ups(records(spark, sf), fleet(spark, sf), order=("time", "reading_id"), urls=urls).select("username", "text")


def mutes(spark, sf):
    """Opt-outs: users by signup events, user and metric by error events."""
    names = F.array(*[F.lit(m[0]) for m in ALERT_METRICS])
    metric = F.when(F.col("event_type") == "error", names[(F.col("event_id") % 6).cast("int")])
    return table(spark, sf, "events").where("event_type in ('error', 'signup') and value > 97").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), metric.alias("metric"))


MUTES_SQL = "mutes as (select concat('user', cast(user_id as varchar)) as username, case when event_type = 'error' then case event_id % 6 " + " ".join(
    f"when {i} then '{m[0]}'" for i, m in enumerate(ALERT_METRICS)) + " end end as metric from events where event_type in ('error', 'signup') and value > 97)"


@query("d5_mute_users", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {MUTES_SQL}
    select reading_id, string_agg(metric, ',' order by {ORDER}) as features from hits where username not in (select username from mutes) group by reading_id""")
def d5(spark, sf):
    kept = al.without_muted(records(spark, sf), mutes(spark, sf), "user")
    return kept.select("reading_id", F.array_join(F.map_keys("features"), ",").alias("features"))


@query("d5_mute_metrics", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {MUTES_SQL}
    select reading_id, metric from hits where not exists
      (select 1 from mutes where mutes.username = hits.username and (mutes.metric is null or mutes.metric = hits.metric))""")
def d5_metrics(spark, sf):
    lines = feature_lines(records(spark, sf))
    return al.without_muted(lines, mutes(spark, sf), "metric").select("reading_id", "metric")


def directory(spark, sf):
    """Directory of the fleet's users: one member per part."""
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.concat(F.lit("U"), key).alias("id"), F.concat(F.lit("user"), key).alias("name"), F.col("p_name").alias("display_name"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("first_name"), F.concat("p_type", F.lit(" Person")).alias("real_name"),
        (F.col("p_size") == 7).alias("deleted"), (F.col("p_size") == 8).alias("is_bot"), F.col("p_partkey").alias("position"))


@query("d2_messages", sql=f"""with {FLEET_SQL}, {HITS_SQL}, {MUTES_SQL}, {RENDERED_SQL},
    people as (select 'user' || cast(p_partkey as varchar) as username, 'U' || cast(p_partkey as varchar) as user_id,
      case when p_size > 25 then p_brand else p_type end as first_name from part where p_size not in (7, 8))
    select username, user_id, {BODY.replace('username', 'first_name')} as body, count(*) as n from rendered join people using (username)
    where username not in (select username from mutes) group by all""")
def d2_messages(spark, sf):
    sent, _ = alerting.messages(fleet(spark, sf), directory(spark, sf), mutes(spark, sf))
    return sent.groupBy("username", "user_id", "body").agg(F.count("*").alias("n"))


@query("t8_message_replies", sql="""
    with articles as (select 'doc' || cast(doc_id as varchar) as metric,
      regexp_replace(regexp_replace(replace(replace(text, '*', ''), '_', ''), '(^|\\n)[-#]', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') as body from documents),
    routed as (select event_id, case event_type when 'view' then 'avg_boot_time' when 'click' then 'battery_cycle'
      when 'error' then 'doc' || cast(event_id % (select count(*) + count(*) // 100 + 1 from documents) as varchar) end as metric from events)
    select event_id, case when routed.metric is null then null else 'Here''s what I know about *' || routed.metric || '*:' || chr(10) || chr(10) || coalesce(body,
      '*No self-help article found for this issue yet.*' || chr(10) || chr(10) || 'Please contact IT directly and mention: `' || routed.metric || '`') end as reply
    from routed left join articles using (metric)""")
def t8_replies(spark, sf):
    # Whole texts, without the signs of markup, whose rewriting T7 checks. Events ask for each article in turn, and for a hundredth more than there are.
    unmarked = F.regexp_replace(F.translate("text", "*_", ""), r"(^|\n)[-#]", "$1")
    documents = table(spark, sf, "documents")
    asked = documents.agg((F.count("*") + F.expr("count(*) div 100") + 1).alias("asked"))
    articles = documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("metric"), unmarked.alias("body"), F.lit("mac").alias("platform"))
    said = F.when(F.col("event_type") == "view", "Why so slow?").when(F.col("event_type") == "click", "my BATTERY dies").otherwise("help")
    raised = F.concat(F.lit("doc"), (F.col("event_id") % F.col("asked")).cast("string"))
    messages = table(spark, sf, "events").crossJoin(F.broadcast(asked)).select("event_id", said.alias("text"), F.when(F.col("event_type") == "error", raised).alias("last_metric"))
    answered = al.answer_messages(messages, articles, alert_dimension(spark))
    return answered.select("event_id", F.when(F.col("reply") != tx.GENERIC_REPLY, F.col("reply")).alias("reply"))


@query("s11_threshold_map", sql=f"""with {FLEET_SQL} select '{{' || string_agg('"' || metric || '":' || cast(t as varchar), ',' order by metric) || '}}' as value from (
    {' union all '.join(f"select '{m[0]}' as metric, max({m[0]}) as t from fleet" for m in ALERT_METRICS)})""")
def s11(spark, sf):
    row = fleet(spark, sf).agg(*[F.max(m[0]).alias(m[0]) for m in ALERT_METRICS])
    long = row.unpivot([], [m[0] for m in ALERT_METRICS], "metric", "threshold")
    return threshold_map(long).select(F.to_json("thresholds").alias("value"))


@query("s13_problem_envelopes", sql=f"""with {FLEET_SQL}, {HITS_SQL}
    select username, device, string_agg(metric || '=' || cast(round(value, 4) as varchar), ';' order by {ORDER}) as features
    from hits group by reading_id, username, device""")
def s13_envelopes(spark, sf):
    path = scratch_path(spark, "problems")
    problem_envelopes(records(spark, sf)).write.text(path)
    listed = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("string"))), ";")
    return read_problem_envelopes(spark, path).select("username", "device", listed.alias("features"))


@query("s13_problem_json", sql=f"""with {FLEET_SQL}, {HITS_SQL}
    select '{{"username":"' || username || '","device":"' || device || '","features":{{' ||
      string_agg('"' || metric || '":' || cast(value as varchar), ',' order by {ORDER}) || '}}}}' as value
    from hits group by reading_id, username, device""")
def s13(spark, sf):
    return problem_records_json(records(spark, sf))
