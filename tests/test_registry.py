import os

import duckdb
import pytest

import __spark_entry__
from glossa.plans import registry
from glossa.plans.adapters import Tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each kind; all are compared by the driver.
CHECKED = [
    "ccr_by_source", "ambiguous_keys", "asc_parse", "ancestor_chain", "same_branch_pairs", "corpus_bleu", "doc_chrf_macro", "kappa_per_field", "adjudication", "semantic_topk", "glossary_draft",
    "phrase_match", "concept_renderings", "htm_alias_tiers", "branch_by_names", "bootstrap_delta_bleu", "segment_locks", "concept_views",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    return str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())


def test_one_supplier_a_part_without_sorting_all_rows(spark):
    """Of a part's suppliers the first by digest, found where the rows are: strings would be sorted, and shuffled before parts are put together."""
    found = Tables(spark, SF)._edges(True)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute("SELECT (3000000 + arg_min(l_suppkey, md5(l_suppkey || '-' || l_partkey)))::VARCHAR, (4000000 + l_partkey)::VARCHAR FROM lineitem GROUP BY l_partkey").fetchall()
    assert sorted(tuple(r) for r in found.where("parent >= '3000000' and parent < '4000000'").collect()) == sorted(want)
