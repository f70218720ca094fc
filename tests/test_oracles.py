"""Every query with an oracle agrees with it over the smallest tables; the others run."""

import pytest
from conftest import SMALL
from oracle import same

from tidemark.plans.registry import collect

QUERIES, ORACLES = collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


#: Queries without an oracle that find nothing in the smallest tables.
EMPTY = {"guard_spoken", "guard_shared", "g_talk_signals"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """All rows are made; the second time they are the same."""
    first, second = (sorted(map(repr, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first == second and (first or name in EMPTY)


def test_entry(spark):
    import __spark_entry__ as entry

    assert "term" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
