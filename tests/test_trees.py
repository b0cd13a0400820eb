"""Forests and boosted trees of histograms next to Spark ML's own fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from devicehealth.operators import trees

FEATURES = ["a", "b", "c", "k"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"id": np.arange(3000), "a": rng.random(3000), "b": rng.integers(0, 9, 3000) * 1.0, "c": rng.normal(size=3000), "k": 1.0})
    rows["y"] = rows["a"] * 10 + rows["b"] * rows["c"] + rng.normal(size=3000)
    rows["z"] = (rows["y"] > 8).astype(float)
    rows["m"] = np.clip(np.floor(rows["y"] / 5), 0, 4)
    rows["w"] = np.where(rows["z"] > 0, 3.0, 0.5)
    return spark.createDataFrame(rows).repartition(4, "id").persist()


def both(make, frame):
    estimator = make()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)
    return [(m, m.transform(vectors).orderBy("id").toPandas()) for m in (estimator.fit(vectors), trees.fit(estimator, frame, FEATURES))]


@pytest.mark.parametrize("make", [lambda: GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, seed=42), lambda: GBTClassifier(labelCol="z", maxIter=4, maxDepth=3, seed=42)])
def test_boosted_trees_are_those_of_spark_ml(frame, make):
    (theirs, a), (ours, b) = both(make, frame)
    assert np.allclose(a["prediction"], b["prediction"], rtol=1e-9) and ours.totalNumNodes == theirs.totalNumNodes
    assert np.allclose(theirs.featureImportances.toArray(), ours.featureImportances.toArray())


@pytest.mark.parametrize("make, label", [
    (lambda: RandomForestRegressor(labelCol="y", numTrees=30, maxDepth=6, seed=42, featureSubsetStrategy="all"), "y"),
    (lambda: RandomForestClassifier(labelCol="z", numTrees=30, maxDepth=6, seed=42, weightCol="w"), "z"),
    (lambda: RandomForestClassifier(labelCol="m", numTrees=30, maxDepth=6, seed=42), "m")])
def test_forests_are_as_good_as_those_of_spark_ml(frame, make, label):
    (theirs, a), (ours, b) = both(make, frame)
    errors = [((rows["prediction"] - rows[label]) ** 2).mean() for rows in (a, b)]
    assert errors[1] < errors[0] * 1.15 + 0.01
    assert np.abs(theirs.featureImportances.toArray() - ours.featureImportances.toArray()).max() < 0.06
    assert ours.getNumTrees == 30 and abs(ours.totalNumNodes / theirs.totalNumNodes - 1) < 0.1


def test_a_row_is_kept_in_a_byte_a_feature(frame):
    """Neither bag counts nor nodes of the trees lie beside a row: those filled the disk."""
    cuts = [np.array([0.5])] * len(FEATURES)
    blocks = trees._packed(frame, FEATURES, "y", None, cuts).collect()
    assert sum(map(len, blocks)) == 3000 * (8 + len(FEATURES)) + 16 * len(blocks)


def test_candidate_cuts():
    assert list(trees.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4), 4)) == [1.5, 2.5]
    assert len(trees.thresholds(np.arange(1000.0), np.ones(1000), 32)) == 31
    assert len(trees.thresholds(np.ones(5), np.ones(5), 32)) == 0


def test_missing_values_raise(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "a double, y double")
    with pytest.raises(Exception, match="missing"):
        trees.fit(RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=2, seed=1), rows, ["a"])


def test_nothing_to_split(spark):
    """A label that never changes, and a feature that never does: one leaf; a tree may also be done before its last level."""
    rows = spark.createDataFrame([(float(i % 2), 5.0, float(i % 2), 3.0) for i in range(40)], "a double, k double, y double, s double")
    assert trees.fit(RandomForestRegressor(labelCol="s", numTrees=3, maxDepth=4, seed=1), rows, ["a"]).totalNumNodes == 3
    assert trees.fit(RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1), rows, ["k"]).totalNumNodes == 3
    model = trees.fit(RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1, featureSubsetStrategy="all"), rows, ["a", "k"])
    assert model.totalNumNodes == 9 and model.predict(_vector(1.0, 5.0)) == 1.0
    boosted = trees.fit(GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1), rows, ["a"])
    assert boosted.predict(_vector(0.0)) == 0.0 and boosted.predict(_vector(1.0)) == 1.0


def _vector(*values):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(*values)
