import duckdb
import pytest

from lathwork.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).collect()
    want = con.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    rows = want.fetchall()
    assert sorted(got[0].asDict()) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in got) == sorted(repr([r[i] for i in at]) for r in rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
