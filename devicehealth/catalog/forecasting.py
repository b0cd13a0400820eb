"""Forecasts on the event series and the daily orders."""

from pyspark.sql import functions as F

from devicehealth.catalog.aggregates import rounded
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import table
from devicehealth.operators import forecast

LEVELS = (0.1, 0.5, 0.9)
GRID_SQL = """seen as (select user_id, date_trunc('day', ts)::timestamp as ts, round(sum(value), 4) as value from events group by all),
    spans as (select user_id, min(ts) as a, max(ts) as b from seen group by user_id),
    grid as (select s.user_id, g.ts, value from (select user_id, unnest(generate_series(a, b, interval 1 day)) as ts from spans) g
      left join seen s2 using (user_id, ts) join spans s using (user_id))"""
SEASONAL_SQL = f"""{GRID_SQL}, y as (select user_id, ts, coalesce(value, 0) as y from grid),
    err as (select a.user_id, a.y - b.y as e from y a join y b on a.user_id = b.user_id and a.ts = b.ts + interval 7 day),
    lev as (select user_id, quantile_cont(e, 0.1) as e1, quantile_cont(e, 0.5) as e5, quantile_cont(e, 0.9) as e9 from err group by user_id),
    steps as (select user_id, b + to_days(cast(h as integer)) as ts, b + to_days(cast((h - 1) % 7 + 1 - 7 as integer)) as src from spans, range(1, 11) r(h)),
    made as (select s.user_id, s.ts, coalesce(y.y, 0) as predictions, coalesce(y.y, 0) + coalesce(e1, 0) as q1, coalesce(y.y, 0) + coalesce(e5, 0) as q5,
      coalesce(y.y, 0) + coalesce(e9, 0) as q9 from steps s left join y on y.user_id = s.user_id and y.ts = s.src left join lev on lev.user_id = s.user_id)"""


def daily(spark, sf):
    """Daily value per user on a regular grid."""
    return forecast.regular_grid(table(spark, sf, "events"), "user_id", "ts", "value", "day", lambda c: F.round(F.sum(c), 4))


@query("g2_regular_grid", sql=f"with {GRID_SQL} select user_id, ts, value from grid")
def g2(spark, sf):
    return daily(spark, sf)


@query("g1_seasonal_forecast", sql=f"""with {SEASONAL_SQL} select user_id, ts, 'value' as target_name, round(predictions, 4) as predictions,
    round(q1, 4) as "0.1", round(q5, 4) as "0.5", round(q9, 4) as "0.9" from made""")
def g1(spark, sf):
    out = forecast.seasonal_forecast(daily(spark, sf), "user_id", "ts", "value", 10, LEVELS)
    return out.select("user_id", "ts", "target_name", F.round("predictions", 4).alias("predictions"), *[F.round(F.col(f"`{q}`"), 4).alias(str(q)) for q in LEVELS])


def order_days(spark, sf):
    """Orders and their value per day and status."""
    return table(spark, sf, "orders").groupBy("o_orderstatus", F.col("o_orderdate").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("*").cast("double").alias("orders"))


SEVERAL_SQL = """d as (select o_orderstatus, o_orderdate as ts, round(sum(o_totalprice), 2) as price, cast(count(*) as double) as orders from orders group by all),
    l as (select o_orderstatus, ts, 'price' as target_name, price as y from d union all select o_orderstatus, ts, 'orders', orders from d),
    ends as (select o_orderstatus, target_name, max(ts) as b from l group by all),
    err as (select a.o_orderstatus, a.target_name, a.y - b.y as e from l a join l b on a.o_orderstatus = b.o_orderstatus and a.target_name = b.target_name and a.ts = b.ts + interval 7 day),
    lev as (select o_orderstatus, target_name, quantile_cont(e, 0.1) as e1, quantile_cont(e, 0.9) as e9 from err group by all),
    steps as (select o_orderstatus, target_name, b + to_days(cast(h as integer)) as ts, b + to_days(cast((h - 1) % 7 + 1 - 7 as integer)) as src from ends, range(1, 8) r(h))
    select s.o_orderstatus, s.target_name, s.ts, round(coalesce(y, 0), 4) as predictions, round(coalesce(y, 0) + coalesce(e1, 0), 4) as "0.1",
      round(coalesce(y, 0) + coalesce(e9, 0), 4) as "0.9" from steps s left join l on l.o_orderstatus = s.o_orderstatus and l.target_name = s.target_name and l.ts = s.src
      left join lev on lev.o_orderstatus = s.o_orderstatus and lev.target_name = s.target_name"""


@query("g4_several_targets", sql=f"with {SEVERAL_SQL}")
def g4(spark, sf):
    out = forecast.several_targets(order_days(spark, sf), "o_orderstatus", "ts", ["price", "orders"], 7, quantile_levels=(0.1, 0.9))
    return out.select("o_orderstatus", "target_name", "ts", F.round("predictions", 4).alias("predictions"),
                      *[F.round(F.col(f"`{q}`"), 4).alias(q) for q in ("0.1", "0.9")])


CHUNKED_SQL = """placed as (select *, row_number() over (partition by user_id order by ts) as p from events),
    chunked as (select *, cast((p - 1) // 20 as integer) as chunk, cast((p - 1) % 20 as integer) as step from placed)"""


@query("g7_array_form", sql=f"""with {CHUNKED_SQL}
    select user_id, chunk, cast(count(*) as integer) as points, first(value order by ts) as first_value, last(value order by ts) as last_value,
      cast(last(event_id order by ts) as double) as last_visit from chunked group by all""")
def g7(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_id", "visits")
    packed = forecast.as_arrays(events, "user_id", "ts", "value", ["visits"], points=20)
    return packed.select("user_id", "chunk", F.size("target").alias("points"), F.element_at("target", 1).alias("first_value"),
                         F.element_at("target", -1).alias("last_value"), F.element_at(F.col("past_covariates")["visits"], -1).alias("last_visit"))


@query("g7_array_to_rows", sql=f"with {CHUNKED_SQL} select user_id, chunk, step, value as target from chunked")
def g7_rows(spark, sf):
    return forecast.from_arrays(forecast.as_arrays(table(spark, sf, "events"), "user_id", "ts", "value", points=20), "user_id")


CUT = "2024-01-24"


@query("g8_forecast_scores", sql=f"""with {GRID_SQL.replace('from events group', f"from events where ts < timestamp '{CUT}' group")},
    {SEASONAL_SQL.split(GRID_SQL + ',')[1].strip()},
    truth as (select user_id, date_trunc('day', ts)::timestamp as ts, round(sum(value), 4) as truth from events where ts >= timestamp '{CUT}' group by all)
    select count(*) as points, round(avg(abs(predictions - truth)), 4) as mae, round(avg((predictions - truth) ** 2), 4) as mse,
      round(avg(cast(truth between q1 and q9 as double)), 6) as coverage from made join truth using (user_id, ts)""")
def g8(spark, sf):
    events = table(spark, sf, "events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    history = forecast.regular_grid(events.where(F.col("ts") < cut), "user_id", "ts", "value", "day", lambda c: F.round(F.sum(c), 4))
    truth = events.where(F.col("ts") >= cut).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 4).alias("truth"))
    out = forecast.score_forecast(forecast.seasonal_forecast(history, "user_id", "ts", "value", 10, LEVELS), truth, "user_id", "ts", "truth")
    return out.select("points", F.round("mae", 4).alias("mae"), F.round("mse", 4).alias("mse"), F.round("coverage", 6).alias("coverage"))


def with_weekday(df):
    return df.withColumn("weekday", F.dayofweek("ts").cast("double")).withColumn("kind", F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("workday"))


def split_future(spark, sf):
    rows = with_weekday(daily(spark, sf))
    cut = F.lit(CUT).cast("timestamp_ntz")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut).drop("value")


TREND_SQL = f"""{GRID_SQL}, o as (select min(ts) as o from grid where ts < timestamp '{CUT}'),
    h as (select user_id, date_diff('day', o, ts) as t, value as y from grid, o where ts < timestamp '{CUT}' and value is not null),
    s as (select user_id, count(*) as n, sum(t) as st, sum(t * t) + 1.0 as stt, sum(y) as sy, sum(t * y) as sty from h group by user_id),
    b as (select user_id, (n * sty - st * sy) / (n * stt - st * st) as slope, (sy * stt - st * sty) / (n * stt - st * st) as base from s)"""


@query("g3_trend_forecast", sql=f"""with {TREND_SQL}
    select user_id, ts, round(base + slope * date_diff('day', o, ts), 4) as predictions from grid join b using (user_id), o where ts >= timestamp '{CUT}'""")
def g3_trend(spark, sf):
    history, future = split_future(spark, sf)
    out = forecast.ridge_forecast(history, future, "user_id", "ts", "value", [], LEVELS)
    return out.select("user_id", "ts", F.round("predictions", 4).alias("predictions"))


@query("g3_covariate_forecast")
def g3(spark, sf):
    history, future = split_future(spark, sf)
    return forecast.ridge_forecast(history, future, "user_id", "ts", "value", ["weekday"], LEVELS)


LAGS = [7, 8, 14]


@query("g5_lag_frame", sql=f"""with {GRID_SQL}, y as (select user_id, ts, coalesce(value, 0) as value from grid),
    keys as (select user_id, ts from y union select user_id, ts + interval 7 day from y union select user_id, ts + interval 8 day from y union select user_id, ts + interval 14 day from y)
    select k.user_id, k.ts, y.value, a.value as lag_7, b.value as lag_8, c.value as lag_14 from keys k left join y using (user_id, ts)
      left join y a on a.user_id = k.user_id and a.ts = k.ts - interval 7 day left join y b on b.user_id = k.user_id and b.ts = k.ts - interval 8 day
      left join y c on c.user_id = k.user_id and c.ts = k.ts - interval 14 day""")
def g5_lags(spark, sf):
    return forecast.lag_frame(daily(spark, sf).na.fill(0.0, ["value"]), "user_id", "ts", "value", LAGS)


def complete_lags(spark, sf):
    lagged = g5_lags(spark, sf)
    return lagged.na.drop(subset=[f"lag_{k}" for k in LAGS])


@query("g5_cross_series")
def g5(spark, sf):
    lagged = complete_lags(spark, sf)
    features = [f"lag_{k}" for k in LAGS]
    return forecast.predict_pooled(forecast.fit_pooled(lagged, "value", features), lagged, "user_id", "ts", "value", LEVELS)


@query("g6_fit_then_reuse")
def g6(spark, sf):
    from pyspark.ml import PipelineModel
    from devicehealth.session import scratch_path
    lagged = with_weekday(complete_lags(spark, sf))
    features = [*[f"lag_{k}" for k in LAGS], "weekday"]
    path = scratch_path(spark, "forecaster")
    forecast.fit_pooled(lagged.where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")), "value", features).write().save(path)
    return forecast.predict_pooled(PipelineModel.load(path), lagged, "user_id", "ts", "value", LEVELS)


@query("g9_categorical_covariates")
def g9(spark, sf):
    history, future = split_future(spark, sf)
    kinds = forecast.categories_of(history, "kind")
    return forecast.ridge_forecast(forecast.one_hot(history, "kind", kinds), forecast.one_hot(future, "kind", kinds), "user_id", "ts", "value",
                                   [f"kind_{k}" for k in kinds[1:]], LEVELS)
