from test_rooms import square

from lathwork.operators import rooms


def test_rounds_store_numbers_and_not_points(spark, monkeypatch):
    kept, stored = [], rooms.settled

    def settled(df):
        out = stored(df)
        kept.append(out)
        return out

    monkeypatch.setattr(rooms, "settled", settled)
    walls = [w for i in range(12) for w in square(4 * i, 0, 4)]
    df = spark.createDataFrame([(s, *(float(v) for v in c)) for s, *c in walls], "s string, ax double, az double, bx double, bz double")
    cycles = rooms.face_cycles(rooms.half_edges(rooms.barrier_edges(df, "s", ("ax", "az"), ("bx", "bz"))))
    rows = cycles.collect()
    rounds = [d for d in kept if "moved" in d.columns]
    assert len(rounds) >= 4 and all(t == "bigint" for d in rounds for c, t in d.dtypes if c != "moved")
    # 37 walls: each face's half-edges have places from its smallest one on, each one's end being the next one's beginning
    assert len(rows) == 74 and len({r.id for r in rows}) == 74
    of = {}
    for r in rows:
        of.setdefault(r.face, {})[r.place] = (r.a, r.b)
    assert sorted(len(v) for v in of.values()) == [4] * 12 + [26]
    for face, ring in of.items():
        n = len(ring)
        assert (face.a, face.b) == ring[0] == min(ring.values()) and all(ring[k][1] == ring[(k + 1) % n][0] for k in range(n))
