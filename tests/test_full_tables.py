"""Queries that are registered over narrowed tables are registered over whole ones as well."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from tests.test_registered import FOLDER
from trustlens.operators.network import reachable


@pytest.mark.parametrize("name", ["FLT-09b", "JOIN-03b", "JOIN-10c", "JOIN-10d", "TRU-16b"])
def test_whole_tables(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    result = connect(FOLDER).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(df.columns, df.collect(), columns, result.fetchall()) == ""


def test_reached_over_many_hops_from_several_seeds(rows):
    edges = rows([*((f"a{i}", f"a{i + 1}") for i in range(6)), ("a6", "a0"), ("b0", "b1"), ("c0", "c1")], "src string, dst string")
    got = {tuple(r) for r in reachable(edges, rows([("a0",), ("b0",)], "username string")).collect()}
    assert got == {*((f"a{i}", i) for i in range(7)), ("b0", 0), ("b1", 1)}
