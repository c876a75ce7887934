"""Every registered query with SQL, compared value by value in DuckDB at the smallest scale."""

import pytest
from compare import compare, duck

from rankspark.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["gauc", "ndcg", "primary", "users", "rows"]
    assert df.count() == 1


@pytest.mark.parametrize("name", ["ranking_report_by_split", "per_user_primary", "fractional_ranks", "negative_numbers", "pair_sample",
                                  "running_best", "improvement_score", "prior_attempts", "lambda_gradients"])
def test_heavy_forms_match_sql(spark, con, name):
    """The forms for hot keys, forced by a bound most keys exceed, give the same values."""
    spark.conf.set("spark.rankspark.heavy.rows", "5")
    try:
        ok, message, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    finally:
        spark.conf.unset("spark.rankspark.heavy.rows")
    assert ok, message
