"""Every core query with SQL gives what DuckDB gives on the smallest tables; the others run and keep their invariants."""

import pytest

from kinweave.plans import general_queries, graph_queries
from tests.conftest import SMALL, check_sql

ALL = {**graph_queries.R.queries, **general_queries.R.queries}
SQL = {**graph_queries.R.sql, **general_queries.R.sql}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    check_sql(spark, duck, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_without_sql_keeps_invariants(spark, name):
    rows = ALL[name](spark, SMALL).collect()
    assert rows
    if {"src", "dst", "rank"} <= set(rows[0].asDict()):
        pairs = [(r["src"], r["dst"]) for r in rows]
        assert len(pairs) == len(set(pairs)) and all(a != b for a, b in pairs)
        by = {}
        for r in rows:
            by.setdefault(r["src"], []).append((r["rank"], -r["sim"]))
        assert all([x for x, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
