import os

import duckdb
import pytest

import __spark_entry__
from glossa.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_all_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
