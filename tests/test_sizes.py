"""Queries that fit models at the operators' own sizes."""

import pytest

from devicehealth.catalog import load
from devicehealth.operators import models


@pytest.mark.parametrize("name, wanted", [("x3_model_root_causes", [(100, 10)]), ("m15_crash_model_report", [(100, 10), (100, 5)])])
def test_full_sizes(spark, monkeypatch, name, wanted):
    sizes, fit = [], models._fit

    def small(estimator, *args):
        trees = "numTrees" if estimator.hasParam("numTrees") else "maxIter"
        sizes.append((estimator.getOrDefault(trees), estimator.getOrDefault("maxDepth")))
        return fit(estimator._set(**{trees: 1, "maxDepth": 1}), *args)

    monkeypatch.setattr(models, "_fit", small)
    load()[0][name](spark, "/root/testdata/sf0.001")
    assert sizes == wanted
