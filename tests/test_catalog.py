"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q for q in ORACLES if not q.startswith("op") and q != "pipeline"))
def test_matches_sql(spark, con, name):
    rows, _, problem = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert problem is None, problem
    assert rows > 0


# Fits at full size that take minutes each; ``compare.py`` runs them.
LONG = {"c2_best_k", "c2_sweep_k", "m6_boosted_regression", "m8_boosted_classification", "m9_diagnosis_model", "m10_likeliest_classes", "m12_metric_models",
        "m13_importance_sweep", "m15_crash_model_report", "m15_extreme_risk_models", "x1_response_curves", "x2_learn_thresholds", "c9_recommended_method",
        "c9_fleet_cluster_report", "c10_extreme_hosts_of_fleet", "m7_risk_report"}


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q not in ORACLES and q not in LONG and q != "pipeline" and not q.startswith("op")))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_flagship(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
