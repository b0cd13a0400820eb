"""Joins."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import alerts, clean, detect, explain, forecast, ordering
from devicehealth.schema import ALERT_METRICS, BASE_FEATURES, alert_dimension

DIMENSION_SQL = "dimension(metric, label, button_label, threshold, lower_is_worse, type, headline, delta_line, unit) as (values " + ", ".join(
    "(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v).lower()
                    for v in row) + ")" for row in ALERT_METRICS) + ")"
LONG_SQL = "long as (" + " union all ".join(
    f"select reading_id, auth_username, model_name, '{m[0]}' as metric, cast({m[0]} as double) as value from fleet" for m in ALERT_METRICS) + ")"
ALERT_NAMES = [m[0] for m in ALERT_METRICS]


@query("j1_semi_join", sql="""
    select event_id, user_id from events where user_id in (select user_id from events where event_type = 'error' and value > 95)""")
def j1(spark, sf):
    events = table(spark, sf, "events")
    valid = events.where((F.col("event_type") == "error") & (F.col("value") > 95)).select("user_id")
    return events.select("event_id", "user_id").join(valid, "user_id", "left_semi")


@query("j2_reading_x_threshold", sql=f"""
    with {FLEET_SQL}, {DIMENSION_SQL}, {LONG_SQL}
    select reading_id, long.metric, value, threshold from long join dimension on long.metric = dimension.metric
    where case when lower_is_worse then value < threshold else value > threshold end""")
def j2(spark, sf):
    long = clean.long_metrics(fleet(spark, sf), ["reading_id"], ALERT_NAMES)
    limits = alert_dimension(spark).select("metric", "threshold", "lower_is_worse")
    return detect.triggered_pairs(long, limits).drop("lower_is_worse")


@query("j3_metric_details", sql=f"""
    with {FLEET_SQL}, {DIMENSION_SQL}, picked as (
      select reading_id, case when uptime_days > 20 then 'uptime_days' else 'unknown_metric' end as metric from fleet)
    select reading_id, picked.metric, coalesce(label, picked.metric) as label, coalesce(button_label, label, picked.metric) as button_label,
      coalesce(type, 'self-service') as type, threshold from picked left join dimension on picked.metric = dimension.metric""")
def j3(spark, sf):
    picked = fleet(spark, sf).select("reading_id", F.when(F.col("uptime_days") > 20, "uptime_days").otherwise("unknown_metric").alias("metric"))
    return alerts.enrich_lines(picked, alert_dimension(spark)).select("reading_id", "metric", "label", "button_label", "type", "threshold")


RECORDS = "concat('user', cast(l_partkey as string)) as username, concat('m', cast(l_linenumber as string)) as metric, l_orderkey, l_suppkey"
MUTED = ("concat('user', cast(user_id as string)) as username, case when event_type = 'error' then concat('m', cast(event_id % 7 as string)) end as metric")


@query("j4_drop_muted_users", sql=f"""
    with r as (select {RECORDS} from lineitem), o as (select {MUTED} from events where event_type in ('error', 'signup') and value > 90)
    select * from r where username not in (select username from o)""")
def j4(spark, sf):
    records = table(spark, sf, "lineitem").selectExpr(*RECORDS_LIST)
    return alerts.without_muted(records, _mutes(spark, sf), "user")


@query("j4b_drop_muted_metrics", sql=f"""
    with r as (select {RECORDS} from lineitem), o as (select {MUTED} from events where event_type in ('error', 'signup') and value > 90)
    select * from r where not exists (select 1 from o where o.username = r.username and (o.metric is null or o.metric = r.metric))""")
def j4b(spark, sf):
    records = table(spark, sf, "lineitem").selectExpr(*RECORDS_LIST)
    return alerts.without_muted(records, _mutes(spark, sf), "metric")


RECORDS_LIST = ["concat('user', cast(l_partkey as string)) as username", "concat('m', cast(l_linenumber as string)) as metric",
                "l_orderkey", "l_suppkey"]


def _mutes(spark, sf):
    events = table(spark, sf, "events").where("event_type in ('error', 'signup') and value > 90")
    return events.selectExpr("concat('user', cast(user_id as string)) as username",
                             "case when event_type = 'error' then concat('m', cast(event_id % 7 as string)) end as metric")


# Directory: customers; every fifth shares a display name with its neighbour.
DIRECTORY = {
    "id": "concat('U', cast(c_custkey as string))",
    "name": "case when c_mktsegment = 'BUILDING' then null else concat('w', cast(c_custkey as string)) end",
    "display_name": "concat('d', cast(cast(floor(c_custkey / 5) as bigint) as string))",
    "first_name": "case when c_nationkey > 12 then '' else c_name end",
    "real_name": "concat('Nation', cast(c_nationkey as string), ' Person')",
    "deleted": "c_acctbal < 0",
    "is_bot": "c_mktsegment = 'MACHINERY'",
    "position": "c_custkey",
}
ASKED = ("case when o_orderstatus = 'F' then concat('U', cast(o_custkey as string)) when o_orderstatus = 'O' then concat('w', cast(o_custkey as string)) "
         "else concat('d', cast(o_custkey as string)) end as username")
DIRECTORY_SQL = "directory as (select " + ", ".join(f"{e} as {n}" for n, e in DIRECTORY.items()) + " from customer)"
RESOLVED_SQL = f"""with {DIRECTORY_SQL}, asked as (select o_orderkey, {ASKED} from orders),
    named as (select *, coalesce(nullif(first_name, ''), split_part(real_name, ' ', 1)) as called from directory),
    hits as (select o_orderkey, username, named.id, called, position from asked join named on
        (username like 'U%' and named.id = username)
        or (username not like 'U%' and not deleted and not is_bot and (name = username or display_name = username))),
    resolved as (select asked.o_orderkey, asked.username, arg_min(hits.id, position) as user_id, arg_min(called, position) as first_name
      from asked left join hits on asked.o_orderkey = hits.o_orderkey group by all)"""


def _resolved(spark, sf):
    directory = table(spark, sf, "customer").selectExpr(*[f"{e} as {n}" for n, e in DIRECTORY.items()])
    asked = table(spark, sf, "orders").selectExpr("o_orderkey", ASKED)
    return alerts.resolve_users(asked, directory)


@query("j5_resolve_users", sql=f"{RESOLVED_SQL} select * from resolved")
def j5(spark, sf):
    return _resolved(spark, sf)


@query("d3_rejects", sql=f"{RESOLVED_SQL} select o_orderkey, username, 'user not found' as reason from resolved where user_id is null")
def d3(spark, sf):
    return alerts.split_rejects(_resolved(spark, sf))[1].select("o_orderkey", "username", "reason")


@query("j6_forecast_vs_truth", sql="""
    with daily as (select user_id, date_trunc('day', ts) as ts, round(sum(value), 4) as target from events group by all),
    forecast as (select user_id, ts + interval 7 day as ts, target as predictions from daily)
    select f.user_id, cast(f.ts as timestamp) as ts, predictions, target from forecast f join daily using (user_id, ts)""")
def j6(spark, sf):
    daily = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.round(F.sum("value"), 4).alias("target"))
    made = daily.select("user_id", (F.col("ts") + F.expr("interval 7 days")).alias("ts"), F.col("target").alias("predictions"))
    return forecast.align(made, daily, "user_id", "ts").select("user_id", "ts", "predictions", "target")


@query("j7_history_and_future", sql="""
    with h as (select user_id, ts, value, length(event_type) as load, event_id as visits from events where ts < timestamp '2024-01-25'),
    f as (select user_id, ts, length(event_type) as load from events where ts >= timestamp '2024-01-25')
    select user_id, ts, value, load, visits, false as is_future from h union all
    select user_id, ts, null, load, null, true from f""")
def j7(spark, sf):
    events = table(spark, sf, "events").withColumn("load", F.length("event_type").cast("bigint")).withColumnRenamed("event_id", "visits")
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    history = events.where(F.col("ts") < cut).select("user_id", "ts", "value", "load", "visits")
    future = events.where(F.col("ts") >= cut).select("user_id", "ts", "load")
    return forecast.with_future(history, future)


@query("j8_latest_alert", sql="""
    with m as (select event_id, user_id, ts from events where event_type <> 'error'),
    a as (select event_id, user_id, ts, value, props from events where event_type = 'error')
    select m.event_id, m.user_id, m.ts, a.ts as matched_ts, a.value, a.props from m asof left join a
      on m.user_id = a.user_id and m.ts >= a.ts""")
def j8(spark, sf):
    events = table(spark, sf, "events")
    messages = events.where("event_type <> 'error'").select("event_id", "user_id", "ts")
    raised = events.where("event_type = 'error'").select("event_id", "user_id", "ts", "value", "props")
    return ordering.as_of(messages, raised, "user_id", "ts", ["value", "props"], "event_id")


@query("j9_article_lookup", sql="""
    with articles as (select case when lang in ('en', 'de') then 'windows' else 'mac' end as platform, concat('doc', cast(doc_id as varchar)) as metric,
        regexp_replace(regexp_replace(replace(replace(text, '*', ''), '_', ''), '(^|\\n)[-#]', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') as body from documents),
    requests as (select o_orderkey, case when o_orderstatus = 'F' then 'windows' else 'mac' end as platform,
        concat('doc', cast(o_custkey as varchar)) as metric from orders)
    select o_orderkey, platform, metric, coalesce(body, '*No self-help article found for this issue yet.*'
        || chr(10) || chr(10) || 'Please contact IT directly and mention: `' || metric || '`') as article
    from requests left join articles using (platform, metric)""")
def j9(spark, sf):
    # Signs of markup are taken out of the texts, whose rewriting T7 checks.
    unmarked = F.regexp_replace(F.translate("text", "*_", ""), r"(^|\n)[-#]", "$1")
    articles = table(spark, sf, "documents").select(
        F.when(F.col("lang").isin("en", "de"), "windows").otherwise("mac").alias("platform"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("metric"), unmarked.alias("body"))
    requests = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "windows").otherwise("mac").alias("platform"),
        F.concat(F.lit("doc"), F.col("o_custkey").cast("string")).alias("metric"))
    return alerts.find_articles(requests, articles).select("o_orderkey", "platform", "metric", "article")


# Importances stand in by each metric's share of the summed deviations.
IMPORTANCE_SQL = ("importance as (select metric, dev / sum(dev) over () as importance from (" + " union all ".join(
    f"select '{m}' as metric, stddev_pop({m}) as dev from fleet" for m in BASE_FEATURES) + "))")
LIMITS_SQL = "limits as (" + " union all ".join(
    f"select '{m}' as metric, quantile_cont({m}, 0.9) as threshold from fleet" for m in BASE_FEATURES) + ")"
VALUES_SQL = "readings as (" + " union all ".join(
    f"select reading_id, '{m}' as metric, cast({m} as double) as value from fleet" for m in BASE_FEATURES) + ")"


@query("j10_contributions", sql=f"""
    with {FLEET_SQL}, {IMPORTANCE_SQL}, {LIMITS_SQL}, {VALUES_SQL}
    select metric, count(*) as readings, round(sum(greatest(value - threshold, 0) * importance), 2) as weight
    from readings join limits using (metric) join importance using (metric) where value is not null group by metric""")
def j10(spark, sf):
    base = fleet(spark, sf)
    weighted = explain.contributions(base, ["reading_id"], BASE_FEATURES, importances(base))
    return weighted.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.count("*").alias("readings"), F.round(F.sum("raw_score"), 2).alias("weight"))


def importances(base):
    """Share of each metric in the summed population deviations."""
    row = base.agg(*[F.stddev_pop(m).alias(m) for m in BASE_FEATURES])
    long = row.unpivot([], BASE_FEATURES, "metric", "dev")
    total = row.select(sum((F.col(m) for m in BASE_FEATURES), F.lit(0.0)).alias("t")).scalar()
    return long.select("metric", (F.col("dev") / total).alias("importance"))
