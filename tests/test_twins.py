"""Every registered query against its SQL twin, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare, database

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# These fit hundreds of trees, some several times; test_training covers them with few.
FORESTS = {"trn11_forest", "trn12_probability", "trn15_cross_validation", "trn16_importances", "trn17_saved_model"}
TWINS = {k: f for k, f in entry.queries().items() if k in ORACLES and k not in FORESTS}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("key", list(TWINS))
def test_twin(spark, con, key):
    ok, note = compare(spark, con, FOLDER, key, TWINS[key], ORACLES[key])
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
