import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["gql_two_hop", "gql_null_ordering", "gqlx_cycle", "bfs_depth3", "edges_valid_at", "pagerank_10", "knn_cosine"]


def plain(v):
    return round(v, 4) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr)
    assert key(r.asDict() for r in df.collect()) == key(dict(zip(names, r, strict=True)) for r in got.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "total", "order_id"] and df.count() == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
