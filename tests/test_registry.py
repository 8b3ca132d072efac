import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few queries of each group; the driver compares all of them.
CHECKED = ["source_kind", "page_main_text", "url_policy", "lexical_search", "multi_space_knn", "hybrid_search", "breadcrumbs", "gate_metrics", "status_summary", "token_rate_60s"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def text(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return str(int(value) if isinstance(value, bool) else value)


def rows(frame):
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry_and_flagship(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
