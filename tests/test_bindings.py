"""Each bound query against its SQL on DuckDB."""

import duckdb
import pytest

from tomewise.plans import bindings, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, list):
        return [plain(v) for v in value]
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", bindings.QUERIES)
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = bindings.QUERIES[name](spark, SF), con.sql(bindings.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    got = [[plain(r[i]) for i in order] for r in df.collect()]
    assert sorted(got, key=str) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)
