"""Incremental processing: bursts, deduplicated arrivals, resumable snapshots.

Each rule is one function for batches; its streaming form gives the same result once the stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, id_col: str, gap_seconds: int) -> DataFrame:
    """Trailing-edge debounce: events of a key no more than the gap apart are one burst, of which the last one counts."""
    w = Window.partitionBy(key).orderBy(ts, id_col)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = events.select(key, ts, id_col, us.alias("_us")).withColumn("_new", F.coalesce(F.col("_us") - F.lag("_us").over(w) > gap_seconds * 1_000_000, F.lit(True)).cast("long"))
    marked = marked.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "burst").agg(F.count("*").alias("n"), F.max_by(id_col, F.struct(ts, id_col)).alias("last_event"))


def burst_stream(events: DataFrame, key: str, ts: str, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """The streaming form with session windows: a burst is final once the watermark has passed its gap."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(key, F.session_window("_ts", f"{gap_seconds} seconds")).agg(F.count("*").alias("n"), F.max("_ts").alias("last_ts"))


def first_arrivals(events: DataFrame, ids: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeated ids; state is kept as long as repeats may come (the watermark)."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(ids).drop("_ts")


class Snapshot:
    """Processes micro-batches into a keyed table and can be stopped and resumed: the table is the state.

    Every batch writes a new version beside the last one and only then names it current, so a batch that is
    processed again after a failure gives the same version.
    """

    def __init__(self, path: str, ids: list[str]) -> None:
        self.path, self.ids = path.rstrip("/"), ids

    def version(self, spark, batch: int) -> str:
        return f"{self.path}/v{batch:08d}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(self.ids)
        if number > 0:
            old = batch.sparkSession.read.parquet(self.version(batch.sparkSession, number - 1))
            fresh = old.unionByName(fresh.join(old.select(*self.ids), self.ids, "left_anti"))
        fresh.write.mode("overwrite").parquet(self.version(batch.sparkSession, number))

    def read(self, spark, number: int) -> DataFrame:
        return spark.read.parquet(self.version(spark, number))


def run_to_end(stream: DataFrame, sink, checkpoint: str) -> None:
    """Processes all that is available through ``foreachBatch`` and ends; a later call goes on where it stopped."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
