import math

import duckdb
import pytest

import __spark_entry__ as entry
from lathwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    v = float(v)
    return None if math.isnan(v) else v + 0.0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_like_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_order_and_partitions_do_not_matter(spark, sf_dir, tmp_path):
    """The same fingerprints from shuffled and repartitioned input."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o.orderBy("o_custkey", "o_totalprice").repartition(13).write.parquet(f"{tmp_path}/orders.parquet")
    a, b = (sorted(map(tuple, catalog.fingerprint(spark, d).collect())) for d in (sf_dir, str(tmp_path)))
    assert a == b


def test_every_customer_adds_walls(spark, sf_dir, tmp_path):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = c.count()
    more = c.withColumn("c_custkey", c["c_custkey"] + 3780).union(c)  # 35 storeys up, where the same walls are left out
    more.write.parquet(f"{tmp_path}/customer.parquet")
    one, two = catalog._building(spark, sf_dir).count(), catalog._building(spark, str(tmp_path)).count()
    assert one >= n and two == 2 * one
    assert catalog.building_loops(spark, str(tmp_path)).count() == 2 * catalog.building_loops(spark, sf_dir).count()


def test_all_trades_like_brute_force(spark, tmp_path):
    """Two chains, one of 20 hops; quantities and discounts are such that none is rare."""
    pairs = [(k, k) for k in range(1, 11)] + [(k + 1, k) for k in range(1, 11)] + [(50, 60), (51, 60)]
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, s, 1.0, 0.0) for i, (_, s) in enumerate(pairs)], "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for c, s in pairs:
        near.setdefault(f"C{c}", set()).add(f"S{s}")
        near.setdefault(f"S{s}", set()).add(f"C{c}")

    def hops(first):
        seen, now = {first: 0}, [first]
        for x in now:
            for y in near[x] - set(seen):
                seen[y] = seen[x] + 1
                now.append(y)
        return seen

    assert {r.node: r.hops for r in catalog.trade_hops(spark, str(tmp_path)).collect()} == hops(min(near))
    assert max(hops(min(near)).values()) == 20
    assert {r.node: r.component for r in catalog.trade_components(spark, str(tmp_path)).collect()} == {x: min(hops(x)) for x in near}


def test_every_axis_is_quantized(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = catalog.quantize_embeddings(spark, sf_dir).collect()
    assert {r.axis for r in rows} == set(range(1, 65))
    assert sum(r.n for r in rows) == 64 * e.count()


def test_planted_dangling_keys(spark, sf_dir, tmp_path):
    """A label of a short document is none; labels and orders without a partner are."""
    for t in ("customer", "part", "documents"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    short = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars <= 500").first().doc_id
    spark.createDataFrame([(short, 1, 0), (-7, 1, 0), (-8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, -1), (2, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.reason: (r.n, r.example) for r in catalog.integrity_of_all(spark, str(tmp_path)).collect()}
    assert got["label without document"] == (2, "-7") and got["order without customer"] == (1, "1")
    assert "label without document" not in {r.reason for r in catalog.integrity_of_all(spark, sf_dir).collect()}
