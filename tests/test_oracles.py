"""Every registered query against its SQL (ORACLE_SF sets the scale)."""

from __future__ import annotations

import os

import pytest
from compare import data_dir, duck, run

from tapeline.plans.catalog import load

SF = os.environ.get("ORACLE_SF", "0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(data_dir(SF))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = run(spark, con, name, QUERIES[name], ORACLES.get(name), data_dir(SF))
    assert ok, message


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
