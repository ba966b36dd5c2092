"""Every registered query against its DuckDB oracle (as the driver checks),
on the smallest scale so the suite stays quick; ``python -m
tests.oracle_compare`` runs the same check at sf0.01."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

NAMES = sorted(entry.queries())
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["partition", "event_type", "n_records", "n_batches", "payload_bytes"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = con.execute(ORACLE[name]).df()
    problems = [p for p in compare(got, want) if not p.startswith("dtype")]
    assert not problems, problems
