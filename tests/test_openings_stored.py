from lathwork.operators import assemblies, boundaries


def test_only_like_openings_are_stored(spark, monkeypatch):
    stored, was = [], assemblies.settled

    def settled(df):
        out = was(df)
        stored.append(out.count())
        return out

    for module in (assemblies, boundaries):
        monkeypatch.setattr(module, "settled", settled)
    # 60 openings far apart, one of them three times, once over a cell's border, and one without a bound
    at = lambda name, score, x: (1, name, "door", score, 2.0, x, x + 1.0, 0.0, 2.0, 0.0, 0.1)
    edge = 2 * assemblies.CELL - 0.5  # its centre is at the border
    rows = [at(f"o{i:02d}", 0.0, 20.0 * i + 100) for i in range(60)] + [at("p0", 1.0, edge - 0.02), at("p1", 0.0, edge + 0.02), at("p2", 0.0, edge + 0.09), (*at("q", 0.0, 0.0)[:5], None, *at("q", 0.0, 0.0)[6:])]
    df = spark.createDataFrame(rows, "model int, id string, kind string, name_score double, area double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = {r.id: r.of for r in assemblies.distinct_openings(df).collect()}
    assert len(got) == 64 and {k: v for k, v in got.items() if v} == {"p1": "p0", "p2": "p0"}
    assert max(stored) <= 3
