from lathwork.operators import graph
from lathwork.plans import catalog


def test_rounds_of_trade_components_store_numbers(spark, sf_dir, monkeypatch):
    stored, was = [], graph.settled

    def settled(df):
        stored.append([t for _, t in df.dtypes])
        return was(df)

    monkeypatch.setattr(graph, "settled", settled)
    got = catalog.trade_components(spark, sf_dir).collect()
    # all but the last one, which brings the names back
    assert len(stored) > 2 and all(t == "bigint" for types in stored[:-1] for t in types)
    assert got and {r.node[0] for r in got} == {"C", "S"} and all(r.component <= r.node for r in got)
