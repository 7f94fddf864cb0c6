"""Faces meet by hashes that are looked at again, and components are found within objects."""

import random

import pytest
from pyspark.sql import functions as F

from lathwork.operators import graph, surfaces


@pytest.mark.parametrize("at_once", [1, 7, 500_000])
def test_components_within_keys_like_union_find(spark, at_once):
    r = random.Random(at_once)
    edges = [(k, f"{k}-{r.randrange(40)}", f"{k}-{r.randrange(40)}") for k in range(6) for _ in range([1, 12, 30, 60, 25, 3][k])] + [(1, None, "1-0")]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, a, b in edges[:-1]:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    df = spark.createDataFrame(edges, "k int, a string, b string").coalesce(1)
    got = graph.components_within(df, "k", at_once=at_once).collect()
    assert len(got) == len({x.node for x in got}) and {x.node: x.component for x in got} == {x: top(x) for x in up}


def test_pieces_of_small_keys_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "connected_components", None)
    df = spark.createDataFrame([(k, f"{k}-{i}", f"{k}-{i + 1}") for k in range(5) for i in range(9)], "k int, a string, b string")
    assert {x.component for x in graph.components_within(df, "k").collect()} == {f"{k}-0" for k in range(5)}


def test_shared_hashes_change_nothing(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for f in range(60):
        x, y, z, wall = r.randrange(3) * 0.2, r.choice([0.0, 0.0004, 0.3]), r.randrange(3) * 0.2, r.random() < 0.3
        p = [(x, y, z), (x, y, z + 0.2), (x, y + 0.5, z + 0.2), (x, y + 0.5, z)] if wall else [(x, y, z), (x, y, z + 0.2), (x + 0.2, y, z + 0.2), (x + 0.2, y, z)]
        rows.append((f % 2, f"f{f:03}", r.choice([0, 0, None]), p, (-1.0, 0.0, 0.0) if wall else (0.0, 1.0, 0.0)))
    df = spark.createDataFrame(rows, "object int, face string, material int, points array<struct<x:double,y:double,z:double>>, normal struct<x:double,y:double,z:double>")
    results = lambda: [sorted(map(tuple, f(df).collect())) for f in (surfaces.connected_faces, surfaces.surface_clusters)]
    want = results()
    assert len({x[2] for x in want[1]}) > len({x[2] for x in want[0]}) > 2
    monkeypatch.setattr(surfaces.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    assert results() == want
