"""Every query with an SQL twin gives the same rows as DuckDB; the others run."""

import os

import pytest
from harness import TESTDATA, compare, duck

from tidewire.plans import catalog

catalog.load()
SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0 or name == "facts_similar"


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).limit(1).count() == 1


def test_keyword_merge_reads_all_articles(spark):
    used = {name: catalog.QUERIES[name](spark, SF).groupBy().sum("freq").first()[0] for name in ("keyword_merged", "keyword_freq")}
    assert used["keyword_merged"] == used["keyword_freq"]
