import numpy as np
from pyspark.sql import functions as F

from lathwork.operators import boundaries


def test_best_rows_of_former_batches_go_along(spark):
    """What a partition's first batch beats is not written again from its later ones, and equals of frontier rows stay."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = spark.range(0, 20000, 1, 2).select("id", *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50))).cast("double").alias(k) for k in "abc"))
        stored = []
        keep, boundaries.settled = boundaries.settled, lambda d: (stored.append(keep(d)), stored[-1])[1]
        try:
            got = {r.id for r in boundaries.undominated(df, [], ["a", "b", "c"]).collect()}
        finally:
            boundaries.settled = keep
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    rows = df.toPandas()
    v = rows[["a", "b", "c"]].to_numpy()
    assert got == {int(i) for i, r in zip(rows["id"], v) if not ((v <= r).all(axis=1) & (v < r).any(axis=1)).any()}
    apart = sum(sum(1 for r in p if not ((p <= r).all(axis=1) & (p < r).any(axis=1)).any()) for p in np.split(v, 20))
    assert stored[0].count() < apart / 2
