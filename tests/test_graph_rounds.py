"""Work of the graph operators' rounds, and of the cells that normals ask in."""

import math
import random

from lathwork.operators import graph, surfaces


def counted(monkeypatch):
    """Rows of every stored step."""
    rows, stored = [], graph.settled

    def settled(df):
        out = stored(df)
        rows.append(out.count())
        assert len(rows) < 200
        return out

    monkeypatch.setattr(graph, "settled", settled)
    return rows


def test_a_long_tail_takes_few_rounds(spark, monkeypatch):
    rows = counted(monkeypatch)
    edges = [(i, i - 1) for i in range(1, 1001)] + [(0, -1), (-1, 0), (5000, 5000), (6000, 6001)]
    for flip in (False, True):
        df = spark.createDataFrame([e[::-1] for e in edges] if flip else edges, "a long, b long")
        assert {r.node for r in graph.on_cycles(df).collect()} == {0, -1, 5000}
    assert len(rows) < 60


def test_components_move_a_few_times_the_edges(spark, monkeypatch):
    rows = counted(monkeypatch)
    n, r = 3000, random.Random(5)
    edges = [(str(i), str(i + 1)) if r.random() < 0.5 else (str(i + 1), str(i)) for i in range(n) if i % 1000 != 999]
    edges += [("loop", "loop"), (None, "1"), ("2", None), ("7", "8")]
    found = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parts = [[str(i) for i in range(lo, lo + 1000)] for lo in range(0, n, 1000)]
    assert found == {x: min(p) for p in parts for x in p} | {"loop": "loop"}
    assert sum(rows) < 10 * n


def test_normals_ask_in_few_cells(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        a = [r.gauss(0, 1) for _ in range(3)]
        size = math.sqrt(sum(v * v for v in a))
        a = [v / size for v in a]
        b = [v + r.gauss(0, 0.05) for v in a]
        size = math.sqrt(sum(v * v for v in b))
        rows.append((i, tuple(a), tuple(v / size for v in b)))
    normal = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"i int, a {normal}, b {normal}")
    asked = {}
    for x in surfaces.asking_cells(df, "b").collect():
        asked.setdefault(x.i, set()).add((x.nx, x.ny, x.nz))
    for i, a, b in rows:
        if sum(p * q for p, q in zip(a, b, strict=True)) >= surfaces.ANGLE:
            assert tuple(math.floor(v / surfaces.NORMAL_CELL + 0.5) for v in a) in asked[i]
    assert sum(map(len, asked.values())) < 6 * len(rows)
    one = spark.createDataFrame([(1, (0.0, 1.0, 0.0))], f"i int, b {normal}")
    assert surfaces.asking_cells(one, "b").count() == 1
