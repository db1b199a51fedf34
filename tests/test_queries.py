"""Every registered query against its DuckDB statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from privacyframes.plans import catalogue

CHECKS = catalogue.checks()


@pytest.fixture(scope="module")
def duck(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, sf_small, name):
    text, _, _, ok = compare(spark, duck, sf_small, name, catalogue.queries()[name], CHECKS.get(name))
    assert ok and "TYPES" not in text, text


def test_every_query_is_checked():
    assert set(CHECKS) == set(catalogue.queries())
    assert set(entry.queries()) >= set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
