"""The queries of the llm operators against their SQL."""

import pytest

from readloom.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_every_problem_of_the_subpackage_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"p{i}" for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)}
