"""Queries of this subpackage against their check SQL."""

import brute
import compare
import pytest

from pollweave.llm.queries import QUERIES

SQL = {key: (query, sql) for key, (query, sql) in QUERIES.items() if sql}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(llm, key):
    query, sql = SQL[key]
    con = compare.connect(brute.SMALL)
    df = query(llm, brute.SMALL)
    names, found = compare.spark_rows(df)
    sql_names, expected = compare.sql_rows(con, sql)
    assert names == sql_names and found == expected
    assert dict(df.dtypes) == compare.sql_types(con, sql)
