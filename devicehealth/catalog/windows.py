"""Windows, sorts, top-k and set operations."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import explain, ordering
from devicehealth.operators.clean import distinct_edges, union_all
from devicehealth.operators.quantiles import quantiles

# One curve per discount: mean price at each of the 50 quantities, summed in whole cents.
CURVE_SQL = """curve as (select concat('d', cast(cast(round(l_discount * 100) as int) as varchar)) as feature,
      cast(l_quantity as int) - 1 as i, l_quantity as x, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * 100) as prediction from lineitem group by all),
    sloped as (select *, case when lag(prediction) over w is null then lead(prediction) over w - prediction
      when lead(prediction) over w is null then prediction - lag(prediction) over w
      else (lead(prediction) over w - lag(prediction) over w) / 2 end as gradient from curve window w as (partition by feature order by i)),
    spiked as (select s.*, row_number() over (partition by feature order by i) - 1 as spike from sloped s
      join (select feature, quantile_cont(gradient, 0.9) as cut from sloped group by feature) using (feature) where gradient > cut)"""


def curve(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("d"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("feature"),
        (F.col("l_quantity").cast("int") - 1).alias("i"), F.col("l_quantity").alias("x")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / (F.count("*") * 100)).alias("prediction"))


@query("w1_gradient", sql=f"with {CURVE_SQL} select feature, i, x, prediction, gradient from sloped")
def w1(spark, sf):
    return explain.gradient(curve(spark, sf))


@query("w2_spikes", sql=f"with {CURVE_SQL} select feature, i, x, cast(spike as integer) as spike from spiked")
def w2(spark, sf):
    return explain.spikes(explain.gradient(curve(spark, sf))).select("feature", "i", "x", "spike")


@query("w3_nth_spike", sql=f"""with {CURVE_SQL}, wanted as (select *, case when feature = 'd0' then 2 when feature = 'd1' then 3 else 4 end as k from spiked)
    select feature as metric, arg_max(x, spike) as threshold, cast(max(spike) as integer) as spike_used, max(spike) = max(k) as complete
    from wanted where spike <= k group by feature""")
def w3(spark, sf):
    positions = {"d0": 2, "d1": 3, **{f"d{i}": 4 for i in range(2, 11)}}
    return explain.nth_spike(explain.spikes(explain.gradient(curve(spark, sf))), positions)


@query("w5_top_per_group", sql=f"""
    with {FLEET_SQL} select host_name, reading_id, total_app_crash, cast(rank as integer) as rank from (
      select host_name, reading_id, total_app_crash, row_number() over (partition by host_name order by total_app_crash desc, reading_id) as rank from fleet)
    where rank <= 5""")
def w5(spark, sf):
    rows = fleet(spark, sf).select("host_name", "reading_id", "total_app_crash")
    return ordering.top_per_group(rows, ["host_name"], [F.desc("total_app_crash"), "reading_id"], 5)


@query("w6_arg_max", sql=f"""
    with {FLEET_SQL}, m as (select host_name, round(avg(total_app_crash), 6) as mean from fleet group by host_name)
    select arg_max(host_name, mean) as worst, max(mean) as worst_mean, arg_min(host_name, mean) as best from m""")
def w6(spark, sf):
    means = fleet(spark, sf).groupBy("host_name").agg(F.round(F.avg("total_app_crash"), 6).alias("mean"))
    return means.agg(F.max_by("host_name", "mean").alias("worst"), F.max("mean").alias("worst_mean"), F.min_by("host_name", "mean").alias("best"))


@query("w7_sorted", sql="select user_id, ts, value from events order by user_id, ts")
def w7(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", "value").orderBy("user_id", "ts")


@query("w8_ordered_position", sql="""
    select event_type, event_id, value, cast(row_number() over (partition by event_type order by value, event_id) as bigint) as position from events""")
def w8(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    return ordering.ordered_position(rows, "value", ["event_type"], ["event_id"])


@query("w9_latest_snapshot", sql=f"""
    with {FLEET_SQL} select auth_username, model_name, reading_id, time, uptime_days from (
      select *, row_number() over (partition by auth_username, model_name order by time desc, reading_id desc) as p from fleet) where p = 1""")
def w9(spark, sf):
    rows = fleet(spark, sf).select("auth_username", "model_name", "reading_id", "time", "uptime_days")
    return ordering.latest_per_key(rows, ["auth_username", "model_name"], ["time", "reading_id"])


@query("w10_distinct_edges", sql=f"""
    with {FLEET_SQL}, e as (select unnest(quantile_cont(cpu_count, [0.0, 0.1, 0.2, 0.5, 0.9, 1.0])) as edge from fleet)
    select distinct round(edge, 6) as edge from e""")
def w10(spark, sf):
    edges = quantiles(fleet(spark, sf), ["cpu_count"], [0.0, 0.1, 0.2, 0.5, 0.9, 1.0]).agg(F.array_sort(F.collect_list("value")).alias("e"))
    return edges.select(F.explode(distinct_edges(F.col("e"))).alias("edge")).select(F.round("edge", 6).alias("edge"))


@query("u1_union_by_name", sql="""
    select l_orderkey, l_partkey, l_quantity from lineitem where l_returnflag = 'A' union all
    select l_orderkey, l_partkey, l_quantity from lineitem where l_returnflag <> 'A'""")
def u1(spark, sf):
    lines = table(spark, sf, "lineitem")
    first = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", "l_quantity")
    second = lines.where("l_returnflag <> 'A'").select("l_quantity", "l_partkey", "l_orderkey")
    return union_all(first, second)
