"""Queries against their SQL on the smallest tables; the driver compares all of them on larger ones."""

import os

import pytest

from spreadloom.plans import registry

from .oracle import compare, database

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.SQL)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    assert compare(spark, db, FOLDER, registry.QUERIES[name], registry.SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
