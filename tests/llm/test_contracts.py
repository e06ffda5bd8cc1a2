"""The registered queries against their SQL, on the small tables."""

import pytest

from cytoloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])
