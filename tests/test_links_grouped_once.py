from pyspark.sql import functions as F

from lathwork.operators import graph
from lathwork.plans import graphs


def test_neighbours_of_ids_that_overlap_and_of_nulls(spark):
    e = spark.createDataFrame([(1, 2, 1.5), (2, 1, 2.0), (1, 1, 9.0), (None, 1, 9.0), (1, None, 9.0), (3, 1, 4.0), (1, 2, 0.5)], "p long, q long, c double")
    got = sorted(map(tuple, graph.neighbours(e, "p", "q", "c").collect()))
    assert got == [(1, 2, 3, 4.0), (1, 3, 1, 4.0), (2, 1, 3, 4.0), (3, 1, 1, 4.0)]


def test_neighbour_costs_join_once_and_deal_links_over_tasks(spark, sf_dir, monkeypatch):
    spread = lambda df: df.withColumn("at", F.spark_partition_id())
    rows = sorted(map(tuple, graphs.neighbour_costs(spark, sf_dir).collect()))
    monkeypatch.setattr(graph, "ROWS_OF_A_TASK", 500)
    df = graphs.neighbour_costs(spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == rows
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # two before, one for each way
    e = spark.range(20_000).select((F.col("id") % 97).alias("p"), (F.col("id") + 100).alias("q"))
    most = spread(graph.neighbours(e, "p", "q", rows=20_000)).groupBy("at").count().agg(F.max("count")).first()[0]
    assert most < 2 * 2 * 500  # both ways
