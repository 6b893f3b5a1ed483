"""Every registered query beside its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as e
from oracle_check import compare, database

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(e.queries()))
def test_query(spark, con, name):
    message, rows, *_ = compare(spark, con, FOLDER, name)
    assert message is None
    assert rows >= 0


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() > 0
