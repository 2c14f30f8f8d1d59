import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["c1_c9_chunks", "k2_j1_s8_cosine_top5", "f1_j4_k4_d7_a13_rrf_fusion", "k1_d4_j3_bm25_top5"])
def test_queries_equal_sql(spark, name):
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in at) for r in found.fetchall()))) == sorted(map(str, map(tuple, frame.select(columns).collect())))
