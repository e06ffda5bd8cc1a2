"""Each registered query against its SQL, on the small tables."""

import pytest

from cytoloom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(name, same_rows):
    same_rows(plans.QUERIES[name], plans.SQL[name])


def test_every_query_without_sql_is_named():
    assert sorted(set(plans.QUERIES) - set(plans.SQL)) == sorted(plans.UNTESTED_BY_SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bench_reports_headlines_that_are_not_registered():
    import bench

    assert bench.missing({n: None for n in bench.HEADLINES if n != "morans_i"}) == ["morans_i"]
