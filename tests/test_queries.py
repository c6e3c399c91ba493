"""Every registered query beside its SQL; those without SQL must return rows."""

import sys

import pytest

import __spark_entry__ as driver
from tunestrata.plans import ORACLES, QUERIES
from tunestrata.plans.check import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) == ""


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    df = driver.entry(spark)
    assert df.columns == ["song_id", "total_plays"]
    assert df.count() > 0


def test_every_oracle_reads_a_given_table():
    for sql in ORACLES.values():
        assert " from " in sql.lower()


def test_entry_without_the_training_data_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "tunestrata.llm", None)  # an import of it now fails
    assert driver.queries().keys() == QUERIES.keys()
    assert driver.oracle_sql() == ORACLES
