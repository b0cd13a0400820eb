"""Evaluation measures on given labels and predictions."""

from pyspark.sql import functions as F

from devicehealth.catalog.aggregates import rounded
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, fleet, table
from devicehealth.operators import evaluate, rollup

# Crash estimate of a reading: the price of a mean unit times its quantity.
SCORED_SQL = "scored as (select l_extendedprice as label, l_quantity * 1500 + l_tax * 1000 as prediction from lineitem)"
CLASSES_SQL = "classes as (select l_linenumber % 4 as label, case when l_quantity > 30 then l_linenumber % 4 else l_linenumber % 3 end as prediction from lineitem)"


def scored(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_extendedprice as label", "l_quantity * 1500 + l_tax * 1000 as prediction")


def classes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_linenumber % 4 as label", "case when l_quantity > 30 then l_linenumber % 4 else l_linenumber % 3 end as prediction")


@query("e1_regression_scores", sql=f"""with {SCORED_SQL} select count(*) as n, round(avg((label - prediction) ** 2), 2) as mse,
    round(avg(abs(label - prediction)), 4) as mae, round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 8) as r2 from scored""")
def e1(spark, sf):
    return evaluate.regression_scores(scored(spark, sf)).select("n", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


@query("e2_accuracy", sql=f"with {CLASSES_SQL} select round(avg(cast(label = prediction as double)), 8) as accuracy from classes")
def e2(spark, sf):
    return rounded(evaluate.accuracy(classes(spark, sf)), 8)


AUC_SQL = """ranked as (select y, avg(r) over (partition by s) as r from (select y, s, row_number() over (order by s) as r from input))
    select round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) as auc from ranked"""


@query("e3_roc_auc", sql=f"""
    with input as (select cast(l_extendedprice > 80000 as bigint) as y, l_quantity as s from lineitem), {AUC_SQL}""")
def e3(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") > 80000).cast("int").alias("label"), F.col("l_quantity").alias("score"))
    return rounded(evaluate.roc_auc(rows), 8)


@query("e3_roc_auc_labels", sql=f"""
    with input as (select cast(quality as bigint) as y, cast(n_chars as double) as s from labels join documents using (doc_id)), {AUC_SQL}""")
def e3_labels(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(evaluate.roc_auc(rows, "quality", "n_chars"), 8)


@query("e4_classification_report", sql=f"""with {CLASSES_SQL}, names as (select distinct c from (select label as c from classes union all select prediction from classes)),
    raw as (select cast(c as varchar) as class, (select count(*) from classes where label = c) as support, (select count(*) from classes where prediction = c) as predicted,
      (select count(*) from classes where prediction = c and label = c) as hits from names),
    pr as (select class, support, coalesce(hits / nullif(predicted, 0), 0.0) as p, coalesce(hits / nullif(support, 0), 0.0) as r from raw),
    per as (select class, p as precision, r as recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0) as f1, support from pr),
    everything as (select class, precision, recall, f1, support from per union all
      select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per union all
      select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from per)
    select class, round(precision, 8) as precision, round(recall, 8) as recall, round(f1, 8) as f1, cast(support as bigint) as support from everything""")
def e4(spark, sf):
    return rounded(evaluate.classification_report(classes(spark, sf)), 8)


@query("e5_detection_accuracy", sql=f"""with {SCORED_SQL}, cut as (select quantile_cont(label, 0.9) as t from scored)
    select round(t, 6) as threshold, round(avg(cast((label >= t) = (prediction >= t) as double)), 8) as risk_accuracy from scored, cut group by t""")
def e5(spark, sf):
    rows = scored(spark, sf)
    out = evaluate.detection_accuracy(rows, evaluate.own_threshold(rows, "label"))
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("risk_accuracy", 8).alias("risk_accuracy"))


@query("e6_confusion", sql=f"""with {CLASSES_SQL} select prediction, count(*) filter (where label = 0) as true_0, count(*) filter (where label = 1) as true_1,
    count(*) filter (where label = 2) as true_2, count(*) filter (where label = 3) as true_3 from classes group by prediction""")
def e6(spark, sf):
    return evaluate.confusion(classes(spark, sf), [0, 1, 2, 3])


@query("e7_residual_histogram", sql=f"""with {SCORED_SQL}, r as (select label - prediction as v from scored), ends as (select min(v) as lo, max(v) as hi from r),
    binned as (select least(cast(floor((v - lo) / (hi - lo) * 50) as integer), 49) as bin, lo, hi from r, ends)
    select bin, round(lo + (hi - lo) * bin / 50, 6) as edge, count(*) as n from binned group by bin, lo, hi""")
def e7(spark, sf):
    return rounded(rollup.histogram(evaluate.residuals(scored(spark, sf)), "residual", 50))


@query("e8_model_choice", sql=f"""with {FLEET_SQL}, t as (
    select 'by_cpu' as model, avg(abs(total_app_crash - avg_processor_time * 6)) as mae from fleet union all
    select 'by_temp', avg(abs(total_app_crash - avg_cpu_temp * 10)) from fleet)
    select arg_min(model, mae) as best, round(min(mae), 6) as score from t""")
def e8(spark, sf):
    rows = fleet(spark, sf)
    tries = [("by_cpu", F.col("avg_processor_time") * 6), ("by_temp", F.col("avg_cpu_temp") * 10)]
    scores = [evaluate.regression_scores(rows.withColumn("p", guess), "total_app_crash", "p").select(F.lit(name).alias("model"), "mae") for name, guess in tries]
    return rounded(evaluate.best_of(scores[0].unionByName(scores[1]), "model", "mae", larger=False))


@query("e9_review_sample", sql="select doc_id, source from documents order by md5(cast(doc_id as varchar)), doc_id limit 20")
def e9(spark, sf):
    return evaluate.review_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 20)


@query("a3_label_counts", sql="select label, count(*) as n from embeddings group by label")
def a3_labels(spark, sf):
    return rollup.frequency(table(spark, sf, "embeddings"), "label")
