"""Every named query against its SQL twin, on whole tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = f"{oracle.DATA}/sf{os.environ.get('TEST_SF', '0.001')}"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR) is None


def test_entry_is_lazy_frame(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "distance", "source", "rank"]
    assert df.count() > 0
