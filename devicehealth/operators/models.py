"""Splits, scaling and Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from devicehealth.functions.numeric import hash_fraction
from devicehealth.operators import trees
from devicehealth.operators.evaluate import own_threshold, regression_and_risk
from devicehealth.operators.explain import ranked_importances
from devicehealth.operators.quantiles import quantiles
from devicehealth.schema import BASE_FEATURES, POSITIVE_TARGETS, predictors_of
from devicehealth.session import small, spread


@dataclass(frozen=True)
class Size:
    """Trees and depth of an ensemble."""
    trees: int
    depth: int


# Full sizes. Forests train level by level over the cluster; smaller presets suit small runs.
CRASH_FOREST = Size(100, 10)
CRASH_BOOSTING = Size(100, 5)
RISK_FOREST = Size(200, 10)
RISK_BOOSTING = Size(200, 5)
DIAGNOSIS_FOREST = Size(300, 12)
EXTREME_FOREST = Size(400, 14)
METRIC_FOREST = Size(200, 12)
PROCESSOR_FOREST = Size(80, 6)
SEED = 42


def split_by_hash(df: DataFrame, *keys: str, train: float = 0.8) -> DataFrame:
    """Add ``is_train``: a stable split by the hash of the row's key, the same on every run and partitioning."""
    return df.withColumn("is_train", hash_fraction(*[F.col(k) for k in keys]) < train)


def split_stratified(df: DataFrame, label: str, *keys: str, train: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first ``train`` share of every class in hash order.

    The cut is an exact quantile of the hash per class, so no class is sorted in one task; the share
    is rounded as the linear quantile falls between two rows.
    """
    hashed = df.withColumn("_h", hash_fraction(*[F.col(k) for k in keys]))
    cuts = quantiles(hashed, ["_h"], [train], by=[label]).select(F.col(label).alias("_l"), F.col("value").alias("_cut"))
    joined = hashed.join(small(cuts), F.col(label) == F.col("_l"))
    return joined.withColumn("is_train", F.col("_h") <= F.col("_cut")).drop("_h", "_l", "_cut")


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test part of a split frame."""
    return df.where("is_train").drop("is_train"), df.where("not is_train").drop("is_train")


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation; a constant column becomes zeros."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({
        c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


def principal_axes(scaled: DataFrame, columns: Sequence[str], k: int = 2):
    """``(frame with pc1..pck, explained variance ratios)`` of centred columns; signs are not fixed."""
    vectors = assemble(scaled, columns, "_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    placed = model.transform(vectors).withColumn("_p", vector_to_array("_p"))
    return placed.select(*scaled.columns, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(v) for v in model.explainedVariance]


def _fit(estimator, df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()):
    """Fit on the features, see ``trees``; returns a pipeline that scores plain columns."""
    rows = spread(df.select(*features, estimator.getLabelCol(), *extra))
    model = trees.fit(estimator.setFeaturesCol("features"), rows, features)
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), model])


def forest_regression(df: DataFrame, features: Sequence[str], label: str, size: Size = CRASH_FOREST, seed: int = SEED) -> PipelineModel:
    return _fit(RandomForestRegressor(labelCol=label, numTrees=size.trees, maxDepth=size.depth, seed=seed, featureSubsetStrategy="all"), df, features)


def boosted_regression(df: DataFrame, features: Sequence[str], label: str, size: Size = CRASH_BOOSTING, seed: int = SEED) -> PipelineModel:
    return _fit(GBTRegressor(labelCol=label, maxIter=size.trees, maxDepth=size.depth, stepSize=0.1, seed=seed), df, features)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight ``n / (classes * n_class)``; the counts are one row per class."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    weights = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, rows / (len(counts) * n))])
    return df.withColumn(name, weights[F.col(label)])


def forest_classification(df: DataFrame, features: Sequence[str], label: str, size: Size = RISK_FOREST, balanced: bool = True,
                          seed: int = SEED) -> PipelineModel:
    estimator = RandomForestClassifier(labelCol=label, numTrees=size.trees, maxDepth=size.depth, seed=seed)
    if balanced:
        df = balanced_weights(df, label, "_weight")
        return _fit(estimator.setWeightCol("_weight"), df, features, ["_weight"])
    return _fit(estimator, df, features)


def boosted_classification(df: DataFrame, features: Sequence[str], label: str, size: Size = RISK_BOOSTING, seed: int = SEED) -> PipelineModel:
    """Binary boosting; the label is 0/1."""
    return _fit(GBTClassifier(labelCol=label, maxIter=size.trees, maxDepth=size.depth, stepSize=0.1, seed=seed), df, features)


def diagnosis_model(df: DataFrame, features: Sequence[str], label: str = "issue", size: Size = DIAGNOSIS_FOREST, seed: int = SEED):
    """``(model, class names)`` of a multiclass forest on text labels."""
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    return forest_classification(indexer.transform(df), features, "_label", size, balanced=False, seed=seed), list(indexer.labels)


def class_probabilities(scored: DataFrame, ids: Sequence[str], classes: Sequence[str], top: int = 3, probability: str = "probability") -> DataFrame:
    """``(*ids, rank, class, probability)``: the likeliest classes of each row, ranked inside the row."""
    ranked = F.array_sort(F.transform(vector_to_array(probability), lambda p, i: F.struct((-p).alias("minus"), i.alias("index"))))
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(*ids, F.posexplode(F.slice(ranked, 1, top)).alias("_r", "_c")).select(
        *ids, (F.col("_r") + 1).alias("rank"), names[F.col("_c.index").cast("int")].alias("class"), (-F.col("_c.minus")).alias("probability"))


def with_confidence(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Add the largest class probability as a percentage."""
    return scored.withColumn("confidence", F.array_max(vector_to_array(probability)) * 100)


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances of the fitted ensemble, largest first."""
    return ranked_importances(spark, features, model.stages[-1].featureImportances.toArray())


def importance_map(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, map(float, model.stages[-1].featureImportances.toArray())))


def metric_model(df: DataFrame, target: str, keys: Sequence[str], size: Size | None = None, features: Sequence[str] | None = None):
    """Per-metric forest: ``(model, scored test part, scores frame)``.

    Scores hold MSE, MAE, R² and the accuracy at the target's p90 over the whole frame.
    """
    features = list(features or predictors_of(target))
    size = size or (PROCESSOR_FOREST if target == "p90_processor_time" else METRIC_FOREST)
    known = df.select(*keys, *features, target).na.drop(subset=[*features, target])
    if target in POSITIVE_TARGETS:
        known = known.where(F.col(target) > 0)
    train, test = parts(split_by_hash(known, *keys))
    model = forest_regression(train, features, target, size)
    scored = model.transform(test)
    return model, scored, regression_and_risk(scored, own_threshold(known, target), target).withColumn("target", F.lit(target))


def importance_sweep(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(BASE_FEATURES), size: Size = METRIC_FOREST,
                     top: int | None = 3) -> DataFrame:
    """Predict every metric from the others and average each metric's importance over the models it fed."""
    known = df.select(*keys, *metrics).na.drop(subset=list(metrics))
    train, _ = parts(split_by_hash(known, *keys))
    train = train.persist()
    summed = dict.fromkeys(metrics, 0.0)
    for target in metrics:
        others = [m for m in metrics if m != target]
        for name, value in importance_map(forest_regression(train, others, target, size), others).items():
            summed[name] += value
    train.unpersist()
    mean = {m: v / (len(metrics) - 1) for m, v in summed.items()}
    ranked = ranked_importances(df.sparkSession, list(mean), list(mean.values())).withColumnRenamed("importance", "avg_importance")
    return ranked.limit(top) if top else ranked
