"""The driver's contract: every query runs, and equals its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from stockyard import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
OWN = set(registry.QUERIES)
#: Many fits each, minutes in all: they run where STOCKYARD_SLOW is set.
SLOW = {"kmeans_sweep", "chosen_k_of_sweep", "feature_ablation", "boosted_grid_cv", "boosted_accuracy", "feature_importance", "seed_stability", "outlier_sensitivity", "cluster_profiles", "boosted_forecasts"}


@pytest.fixture(scope="module")
def con():
    from tests.verify import connect

    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in OWN))
def test_equals_sql(spark, con, name):
    from tests.verify import compare

    said, _ = compare(spark, con, name, SF)
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(OWN - set(entry.oracle_sql()) - (set() if os.environ.get("STOCKYARD_SLOW") else SLOW)))
def test_runs(spark, name):
    # Its groups need 20 rows, which the smallest tables don't have.
    df = entry.queries()[name](spark, SF.replace("0.001", "0.01") if name == "operator_isolation" else SF)
    rows = df.collect()
    spark.catalog.clearCache()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)


def test_entry_without_the_llm_packages(monkeypatch):
    """A module that is missing, there or below, takes none of the other queries down."""
    import importlib

    def missing(name, *_):
        raise ImportError(name)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(entry.queries()) == OWN and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
