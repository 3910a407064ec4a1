"""Every registered query against its SQL, and the shape of the registry."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    status, rows, _, detail = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    if name in ORACLES:
        assert status == "ok", detail
    else:  # operators beyond SQL are compared with brute force in tests of their own
        assert status == "rows-only" and rows > 0, detail


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["label", "n"] and df.count() > 0


def test_known_answer(spark):
    """Counts of the event table that were worked out before the operators were written."""
    from pyspark.sql import functions as F

    from cohortflow.plans.event_queries import table
    from cohortflow.plans.hosts import Hosts

    got = {r.valid_time: r for r in table(Hosts(spark, "/root/testdata/sf0.01")).groupBy(
        "valid_time").agg(F.count("*").alias("n"), F.avg("dur_ms").alias("m")).collect()}
    assert (got[True].n, got[False].n) == (7166, 2092)
    assert got[True].m == pytest.approx(4237.659643)
