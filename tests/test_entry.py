import __spark_entry__ as entry


def test_queries_and_oracles_match():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert "diverse_passages" in queries and set(oracle) <= set(queries)
