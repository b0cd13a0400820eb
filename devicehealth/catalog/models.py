"""Models on the stand-in fleet, at full size but for the loops over many targets (m12, m13, m15_extreme); rows only, except the splits."""

from pyspark.sql import functions as F

from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import FLEET_SQL, USER_METRICS, fleet
from devicehealth.functions.labels import diagnosis, risk_status
from devicehealth.operators import evaluate, models, rollup
from devicehealth.operators.models import Size
from devicehealth.plans import crash_models
from devicehealth.schema import BASE_FEATURES, CRASHES, DIAGNOSIS_FEATURES, MODEL_TARGETS

SMALL = Size(8, 5)


def known(spark, sf):
    """Complete readings with their key and crashes."""
    return fleet(spark, sf).select("reading_id", "p90_processor_time", *BASE_FEATURES, CRASHES).na.drop()


@query("m1_split_by_hash", sql=f"""
    with {FLEET_SQL} select reading_id, cast(('0x' || substr(md5(reading_id), 1, 13)) as bigint) / 4503599627370496.0 < 0.8 as is_train from fleet""")
def m1(spark, sf):
    return models.split_by_hash(fleet(spark, sf).select("reading_id"), "reading_id")


@query("m2_split_stratified", sql=f"""
    with {FLEET_SQL}, h as (select reading_id, model_name, cast(('0x' || substr(md5(reading_id), 1, 13)) as bigint) as h from fleet where model_name is not null),
    r as (select *, row_number() over (partition by model_name order by h) as p, count(*) over (partition by model_name) as n from h)
    select reading_id, model_name, p - 1 <= 0.8 * (n - 1) as is_train from r""")
def m2(spark, sf):
    return models.split_stratified(fleet(spark, sf).select("reading_id", "model_name"), "model_name", "reading_id")


@query("m4_principal_axes")
def m4(spark, sf):
    from devicehealth.catalog.clustering import scaled_users
    placed, ratios = models.principal_axes(scaled_users(spark, sf), USER_METRICS)
    return placed.select("user_id", "pc1", "pc2").withColumns({"ratio1": F.lit(ratios[0]), "ratio2": F.lit(ratios[1])})


@query("m5_forest_regression")
def m5(spark, sf):
    train, test = models.parts(models.split_by_hash(known(spark, sf).where(F.col(CRASHES) > 0), "reading_id"))
    model = models.forest_regression(train, BASE_FEATURES, CRASHES)
    return model.transform(test).select("reading_id", CRASHES, "prediction")


@query("m6_boosted_regression")
def m6(spark, sf):
    train, test = models.parts(models.split_by_hash(known(spark, sf).where(F.col(CRASHES) > 0), "reading_id"))
    model = models.boosted_regression(train, BASE_FEATURES, CRASHES)
    return model.transform(test).select("reading_id", CRASHES, "prediction")


def labelled(spark, sf):
    return rollup.high_risk_label(known(spark, sf), CRASHES)


@query("m7_forest_classification")
def m7(spark, sf):
    train, test = models.parts(models.split_stratified(labelled(spark, sf), "high_risk", "reading_id"))
    model = models.forest_classification(train, BASE_FEATURES, "high_risk", models.RISK_FOREST)
    return models.with_confidence(model.transform(test)).select("reading_id", "high_risk", "prediction", "confidence")


@query("m8_boosted_classification")
def m8(spark, sf):
    train, test = models.parts(models.split_stratified(labelled(spark, sf), "high_risk", "reading_id"))
    model = models.boosted_classification(train, BASE_FEATURES, "high_risk", models.RISK_BOOSTING)
    return models.with_confidence(model.transform(test)).select("reading_id", "high_risk", "prediction", "confidence")


def diagnosed(spark, sf):
    return known(spark, sf).withColumn("issue", diagnosis())


@query("m9_diagnosis_model")
def m9(spark, sf):
    train, test = models.parts(models.split_stratified(diagnosed(spark, sf), "issue", "reading_id"))
    model, classes = models.diagnosis_model(train, DIAGNOSIS_FEATURES, "issue", models.DIAGNOSIS_FOREST)
    names = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(test).withColumn("predicted_issue", names[F.col("prediction").cast("int")])
    return evaluate.classification_report(scored, "issue", "predicted_issue")


@query("m10_likeliest_classes")
def m10(spark, sf):
    rows = diagnosed(spark, sf)
    model, classes = models.diagnosis_model(rows, DIAGNOSIS_FEATURES, "issue", models.DIAGNOSIS_FOREST)
    return models.class_probabilities(model.transform(rows), ["reading_id"], classes, 3)


@query("m11_importances")
def m11(spark, sf):
    model = models.forest_regression(known(spark, sf), BASE_FEATURES, CRASHES)
    return models.importances(model, BASE_FEATURES, spark)


@query("m12_metric_models")
def m12(spark, sf):
    return crash_models.metric_models(known(spark, sf), ["reading_id"], MODEL_TARGETS, Size(3, 4))


@query("m13_importance_sweep")
def m13(spark, sf):
    return models.importance_sweep(known(spark, sf), ["reading_id"], BASE_FEATURES, Size(3, 4))


@query("m14_score_new_devices")
def m14(spark, sf):
    train, fresh = models.parts(models.split_by_hash(labelled(spark, sf), "reading_id"))
    model = models.forest_classification(train, BASE_FEATURES, "high_risk", models.RISK_FOREST)
    scored = models.with_confidence(model.transform(fresh))
    return scored.select("reading_id", risk_status(F.col("prediction")).alias("status"), "confidence")


@query("m15_extreme_risk_models")
def m15(spark, sf):
    return crash_models.extreme_risk(known(spark, sf), ["reading_id"], BASE_FEATURES, SMALL)


@query("m15_crash_model_report")
def m15_report(spark, sf):
    return crash_models.crash_report(known(spark, sf), ["reading_id"])


@query("m7_risk_report")
def m7_report(spark, sf):
    return crash_models.risk_report(known(spark, sf), ["reading_id"])
