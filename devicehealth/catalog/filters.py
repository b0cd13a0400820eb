"""Row filters."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import clean

# Messages: conversation turns; the role says who wrote them.
MESSAGES = ("conv_id, turn, case when role = 'system' then 'channel' else 'im' end as channel_type, "
            "case when role = 'assistant' then 'B1' end as bot_id, text")


@query("f1_positive_target", sql=f"with {FLEET_SQL} select reading_id, total_app_crash from fleet where total_app_crash > 0")
def f1(spark, sf):
    return clean.positive(fleet(spark, sf).select("reading_id", "total_app_crash"), "total_app_crash")


@query("f4_known_user_device", sql=f"""
    with {FLEET_SQL} select reading_id, auth_username, model_name from fleet
    where auth_username <> '' and model_name is not null and model_name <> ''""")
def f4(spark, sf):
    return clean.known_user_and_device(fleet(spark, sf).select("reading_id", "auth_username", "model_name"))


@query("f5_series_with_rows", sql="""
    select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in
      (select l_orderkey from lineitem group by l_orderkey having count(*) >= 3)""")
def f5(spark, sf):
    return clean.series_with_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 3)


@query("f6_one_slice", sql="select user_id, ts, value from events where event_type = 'view'")
def f6(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type") == "view").select("user_id", "ts", "value")


@query("f7_last_points", sql="""
    select user_id, ts, value from (select user_id, ts, value, row_number() over (partition by user_id order by ts desc, value) as p from events)
    where p <= 24""")
def f7(spark, sf):
    return clean.last_points(table(spark, sf, "events").select("user_id", "ts", "value"), "user_id", "ts", 24, tie=["value"])


@query("f8_low_confidence", sql="""
    with p as (select vec_id, list_transform(embedding, lambda x: abs(cast(x as double))) as probs from embeddings)
    select vec_id, list_max(probs) as top from p where list_max(probs) < 0.3""")
def f8(spark, sf):
    probs = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("probs"))
    return clean.low_confidence(probs, "probs", 0.3).select("vec_id", F.array_max("probs").alias("top"))


@query("f9_user_messages", sql=f"""
    with m as (select {MESSAGES} from conversations)
    select conv_id, turn from m where channel_type = 'im' and coalesce(bot_id, '') = '' and length(trim(text)) > 0""")
def f9(spark, sf):
    return clean.user_messages(table(spark, sf, "conversations").selectExpr(*_split(MESSAGES))).select("conv_id", "turn")


def _split(columns):
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return out + [part.strip()]


@query("f10_active_members", sql="""
    select c_custkey, c_name from customer where not (c_acctbal < 0) and not (c_mktsegment = 'MACHINERY')""")
def f10(spark, sf):
    members = table(spark, sf, "customer").select(
        "c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("deleted"), (F.col("c_mktsegment") == "MACHINERY").alias("is_bot"))
    return clean.active_members(members).select("c_custkey", "c_name")
