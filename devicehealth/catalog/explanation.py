"""Response curves and learned thresholds."""

from pyspark.sql import functions as F

from devicehealth.catalog.aggregates import rounded
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import explain, models
from devicehealth.plans import thresholds
from devicehealth.schema import BASE_FEATURES, CRASHES, THRESHOLD_FEATURES

STATS_SQL = "stats as (" + " union all ".join(
    f"select '{m}' as feature, cast(min({m}) as double) as lo, cast(max({m}) as double) as hi, quantile_cont({m}, 0.5) as mid from fleet" for m in THRESHOLD_FEATURES) + ")"


@query("x1_response_grid", sql=f"""
    with {FLEET_SQL}, {STATS_SQL}, grid as (select feature, cast(i as integer) as i, lo + (hi - lo) * i / 49 as x from stats, range(50) r(i))
    select feature, i, round(x, 6) as x, """ + ", ".join(
    f"round(case when feature = '{m}' then x else (select mid from stats where feature = '{m}') end, 6) as {m}" for m in THRESHOLD_FEATURES) + " from grid")
def x1(spark, sf):
    return rounded(explain.response_grid(fleet(spark, sf), THRESHOLD_FEATURES))


@query("x1_response_curves")
def x1_curves(spark, sf):
    return thresholds.response_curves(fleet(spark, sf), ["reading_id"])


@query("x2_learn_thresholds")
def x2(spark, sf):
    return thresholds.learn_thresholds(fleet(spark, sf), ["reading_id"])


# A curve over the tables, a flat one beside it, and a feature that has none.
POSITIONS = {"quantity": 2, "flat": 0, "absent": 1}


@query("x2_complete_thresholds", sql="""
    with curve as (select 'quantity' as feature, cast(l_quantity as integer) as i, cast(l_quantity as double) as x, cast(avg(l_extendedprice * (1 + l_quantity * l_quantity % 7)) as double) as prediction
      from lineitem group by l_quantity union all select distinct 'flat', cast(l_quantity as integer), cast(l_quantity as double), 1.0 from lineitem),
    g as (select *, lag(prediction) over w as p, lead(prediction) over w as n from curve window w as (partition by feature order by i)),
    s as (select feature, i, x, case when p is null then n - prediction when n is null then prediction - p else (n - p) / 2 end as slope from g),
    k as (select feature, x, row_number() over (partition by feature order by i) - 1 as spike from s join (select feature, quantile_cont(slope, 0.9) as q from s group by feature) using (feature) where slope > q),
    wanted(metric, pos) as (values ('quantity', 2), ('flat', 0), ('absent', 1))
    select metric, max_by(x, spike) as threshold, cast(max(spike) as integer) as spike_used, coalesce(max(spike) = max(pos), false) as complete
    from wanted left join k on feature = metric and spike <= pos group by metric""")
def x2_complete(spark, sf):
    lines = table(spark, sf, "lineitem")
    quantity = F.col("l_quantity").cast("int")
    price = F.col("l_extendedprice") * (1 + F.col("l_quantity") * F.col("l_quantity") % 7)
    curve = lines.groupBy(quantity.alias("i")).agg(F.avg(price).cast("double").alias("prediction")).withColumn("feature", F.lit("quantity"))
    flat = curve.withColumns({"feature": F.lit("flat"), "prediction": F.lit(1.0)})
    both = curve.unionByName(flat).withColumn("x", F.col("i").cast("double"))
    return thresholds.thresholds_of(both, POSITIONS)


@query("x2_training_rows", sql=f"""
    with {FLEET_SQL}, known as (select * from fleet where {' and '.join(f'{m} is not null' for m in THRESHOLD_FEATURES)} and total_app_crash is not null)
    select reading_id, total_app_crash, cast(('0x' || substr(md5(reading_id), 1, 13)) as bigint) / 4503599627370496.0 < 0.8 as is_train from known
    where total_app_crash >= (select quantile_cont(total_app_crash, 0.9) from known)""")
def x2_rows(spark, sf):
    return thresholds.training_rows(fleet(spark, sf), ["reading_id"]).select("reading_id", "total_app_crash", "is_train")


@query("x3_model_root_causes")
def x3_model(spark, sf):
    rows = fleet(spark, sf).select("reading_id", *BASE_FEATURES, CRASHES).na.drop()
    weights = models.importance_map(models.forest_regression(rows, BASE_FEATURES, CRASHES), BASE_FEATURES)
    return explain.root_causes(rows, ["reading_id"], BASE_FEATURES, weights, top=5)


LOW = "avg_battery_health"


@query("x3_direction_aware", sql=f"""
    with {FLEET_SQL}, q as (select quantile_cont(avg_battery_health, 0.1) as b, quantile_cont(avg_cpu_temp, 0.9) as t from fleet),
    s as (select reading_id, avg_battery_health, avg_cpu_temp, greatest(b - avg_battery_health, 0) * 0.25 as sb, greatest(avg_cpu_temp - t, 0) * 0.75 as st from fleet, q),
    l as (select reading_id, '{LOW}' as metric, avg_battery_health as value, 100 * sb / (sb + st) as confidence from s where sb + st > 0 union all
      select reading_id, 'avg_cpu_temp', avg_cpu_temp, 100 * st / (sb + st) from s where sb + st > 0)
    select reading_id, cast(row_number() over (partition by reading_id order by confidence desc, metric) as integer) as rank, metric, value, round(confidence, 4) as confidence
    from l where confidence > 0""")
def x3_direction(spark, sf):
    out = explain.root_causes(fleet(spark, sf), ["reading_id"], [LOW, "avg_cpu_temp"], {LOW: 0.25, "avg_cpu_temp": 0.75}, lower_is_worse={LOW})
    return out.withColumn("confidence", F.round("confidence", 4))
