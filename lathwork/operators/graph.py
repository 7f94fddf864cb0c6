"""Graphs as edge tables: components, hops, reach, degrees, hierarchies, cycles."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up

#: Rows that one task sorts or groups; larger tables are dealt over more tasks, so that a task's memory does not grow with them.
ROWS_OF_A_TASK = 1_000_000
#: Edges that a task holds at once while it contracts them.
EDGES_AT_ONCE = 500_000


def _shared(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/lathwork"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that loops build no lineage and survive lost executors."""
    path = f"{_shared(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """By keys over as many tasks as ``rows`` rows need, and no fewer than the session's; tables that fit one task are left as they are."""
    if rows <= ROWS_OF_A_TASK:
        return df
    return df.repartition(max(-(-rows // ROWS_OF_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable.

    In each round every node goes to that of its neighbours and itself whose hash, another one each round, is least, and the
    edges between the nodes that are left go on: a quarter of the nodes at least is expected to vanish each time, whatever the
    graph, so that all rounds together move a few times the edges.  Then the ways are gone back, and the smallest of each group names it.
    """
    left = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    left = settled(left.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    ways: list[DataFrame] = []
    while not ways or not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(ways)), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.select("x", "y").union(left.select("y", "x"))
        best = both.groupBy("x").agg(F.min(rank("y")).alias("r"))
        to = settled(best.select(F.col("x").alias("node"), F.least("r", rank("x"))["n"].alias("to")))
        ways.append(to)
        ends = left.where("x <> y").join(to.select(F.col("node").alias("x"), F.col("to").alias("p")), "x").join(to.select(F.col("node").alias("y"), F.col("to").alias("q")), "y")
        left = settled(ends.where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
    found = ways.pop()
    for way in reversed(ways):
        found = settled(way.join(found.select(F.col("node").alias("to"), F.col("to").alias("_end")), "to", "left").select("node", F.coalesce("_end", "to").alias("to")))
    names = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(names, "to").select("node", "component")


def _contracted(at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, a, b) in order of key: (whole, node, component) of the edges of a piece; whole if all edges of the key are in it."""

    def smallest(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The nodes of some edges and, of each, the smallest that these edges reach."""
        nodes = pc.unique(pa.concat_arrays([a, b]))
        nodes = nodes.take(pc.sort_indices(nodes))
        x, y = (pc.index_in(c, value_set=nodes).to_numpy() for c in (a, b))
        least = np.arange(len(nodes))
        while len(x):
            x, y = least[x], least[y]
            apart = x != y
            x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(least, y, x)
            while (on := least[least] != least).any():
                least[on] = least[least[on]]
        return nodes, nodes.take(pa.array(least))

    def found(part: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        if part.num_rows:
            nodes, least = smallest(*(pa.concat_arrays(part.column(i).chunks) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), whole)), nodes, least], names=["whole", "node", "component"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        torn, rows = None, 0

        def pieces(part: pa.Table) -> Iterator[pa.RecordBatch]:
            # what went on from the piece before comes first
            cut = 0 if torn is None else int(pc.sum(pc.equal(part.column(0), torn)).as_py() or 0)
            yield from found(part.slice(0, cut), False)
            yield from found(part.slice(cut), True)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < at_once:
                continue
            table = pa.Table.from_batches(held)
            last = table.column(0)[rows - 1]
            start = rows - int(pc.sum(pc.equal(table.column(0), last)).as_py())
            if start:
                yield from pieces(table.slice(0, start))
                torn = None if torn is not None and torn.as_py() != last.as_py() else torn
                held = table.slice(start).combine_chunks().to_batches()
            else:
                yield from found(table, False)
                torn, held = last, []
            rows = sum(b.num_rows for b in held)
        if rows:
            yield from pieces(pa.Table.from_batches(held))

    return each


def components_within(edges: DataFrame, key: str, a: str = "a", b: str = "b", at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, component), as :func:`connected_components`, of edges that each lie within one key (not null) and whose nodes belong to one key only.

    Edges move once, by key.  A task goes through them in order of key, so many at a time; keys that fit are done with.  Of larger ones
    each piece is contracted to its nodes with the smallest that they reach in it, and these go on in rounds.
    """
    rows = edges.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").repartition("k").sortWithinPartitions("k")
    node = rows.schema["a"].dataType.simpleString()
    parts = settled(rows.mapInArrow(_contracted(at_once), f"whole boolean, node {node}, component {node}"))
    done, rest = parts.where("whole").select("node", "component"), parts.where("not whole").select("node", "component")
    return done if rest.isEmpty() else done.unionByName(connected_components(rest, "node", "component"))


def hops(edges: DataFrame, sources: DataFrame, limit: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, hops) from the nearest source over undirected edges; nodes that can't be reached are not listed.

    Goes on until nothing new is found; with a limit, nodes farther away are not listed either.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = settled(both.union(both.select("y", "x")).distinct())
    known = settled(sources.select(F.col(sources.columns[0]).alias("node"), F.lit(0).alias("hops")).distinct())
    for depth in itertools.count(1) if limit is None else range(1, limit + 1):
        edge = known.where(F.col("hops") == depth - 1).join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        fresh = settled(edge.join(known, "node", "left_anti").withColumn("hops", F.lit(depth)))
        if fresh.isEmpty():
            break
        known = settled(known.unionByName(fresh))
    return known


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree): distinct neighbours."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    return both.union(both.select("other", "node")).distinct().groupBy("node").agg(F.count("*").alias("degree"))


def hierarchy(nodes: DataFrame, node: str, parent: str, attribute: str, name: str, limit: int = 1000) -> DataFrame:
    """Every node below the roots with depth, path of names and the attribute of its nearest ancestor that has one.

    A path that would meet a node again stops there; one of more than ``limit`` levels is an error.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).cast("string").alias("name"), F.col(attribute).alias("own"))
    level = settled(rows.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("name").alias("path"), F.col("own").alias("inherited"), F.array("node").alias("seen")))
    out = level
    for depth in range(1, limit + 1):
        p = level.select(F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("inherited").alias("_inherited"), F.col("seen").alias("_seen"))
        below = rows.join(p, "parent").where(~F.expr("array_contains(_seen, node)"))
        level = settled(below.select("node", F.lit(depth).alias("depth"), F.concat_ws("/", "_path", "name").alias("path"), F.coalesce("own", "_inherited").alias("inherited"), F.concat("_seen", F.array("node")).alias("seen")))
        if level.isEmpty():
            return out.drop("seen")
        out = out.unionByName(level)
    raise ValueError(f"the hierarchy has more than {limit} levels")


def on_cycles(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node): those left when nodes without incoming or without outgoing edges are peeled off again and again.

    Where no node has two successors, nor after turning all edges round, edges are doubled instead: the ends of ways of 1, 2, 4
    ... steps are what is left, until no more vanish, so that a long tail takes the logarithm of its length in rounds.
    """
    left = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    for x, y in (("a", "b"), ("b", "a")):
        if left.groupBy(x).count().where("count > 1").isEmpty():
            return _on_cycles_of_one(left.select(F.col(x).alias("a"), F.col(y).alias("b")))
    n = left.count()
    while n:
        heads, tails = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
        left = settled(left.join(heads, "a", "left_semi").join(tails, "b", "left_semi"))
        was, n = n, left.count()
        if n == was:
            break
    return left.select(F.col("a").alias("node")).distinct()


def _on_cycles_of_one(left: DataFrame) -> DataFrame:
    """The same where each a has one b.  What ways of any length end in is closed under them; once all of it is met again, they are cycles."""
    n = left.count()
    while n:
        kept = settled(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        was, n = n, kept.count()
        if n == was:
            break
        left = settled(kept.join(kept.select(F.col("a").alias("b"), F.col("b").alias("_next")), "b").select("a", F.col("_next").alias("b")))
        n = left.count()
    return left.select(F.col("a").alias("node"))


def without_access(nodes: DataFrame, passages: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes with no passage at all."""
    used = passages.select(F.col(a).alias(node)).union(passages.select(F.col(b))).distinct()
    return nodes.join(used, node, "left_anti")


def neighbours(edges: DataFrame, a: str = "a", b: str = "b", cost: str | None = None, rows: int = 0) -> DataFrame:
    """(node, other, links, cost): each node's distinct neighbours, with the number of links and their summed measure.

    Links are grouped once for both ways; ``rows``, where known, says how many there are, so that no task groups too many.
    """
    measure = F.col(cost) if cost else F.lit(1.0)
    apart = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), measure.alias("cost"))
    pairs = dealt(apart, rows, "x", "y").groupBy("x", "y").agg(F.count("*").alias("links"), F.sum("cost").alias("cost"))
    way = lambda p, q: F.struct(F.col(p).alias("node"), F.col(q).alias("other"))
    return pairs.select(F.explode(F.array(way("x", "y"), way("y", "x"))).alias("w"), "links", "cost").select("w.node", "w.other", "links", "cost")


def circulation(rooms: DataFrame, openings: DataFrame, room: str = "room") -> DataFrame:
    """How people get about: per room its access, steps to an exit, likelihood of circulation and a movement score.

    rooms have room, use and width; openings room, other (null for the outside), kind, exterior and width.  Doors and
    open passages are ways; exits are rooms with an exterior door, corridors and staircases.
    """
    ways = openings.where(F.col("kind").isin("door", "open_passage")).where(F.col(room).isNotNull())
    hub = F.coalesce(F.col("use").isin("corridor", "staircase"), F.lit(False))
    outside = ways.where(F.col("exterior") & (F.col("kind") == "door")).select(room).distinct()
    exits = settled(rooms.where(hub).select(room).union(outside).distinct())
    steps = hops(ways.where("other is not null").select(F.col(room).alias("a"), F.col("other").alias("b")), exits).select(F.col("node").alias(room), F.col("hops").alias("steps"))
    to_exit = exits.select(F.col(room).alias("other"), F.lit(True).alias("_exit"))
    per = ways.join(to_exit, "other", "left").groupBy(room).agg(F.count("*").alias("ways"), F.max((F.col("exterior") & (F.col("kind") == "door")).cast("int")).alias("_out"), F.sum((F.col("exterior") | F.coalesce("_exit", F.lit(False))).cast("int")).alias("entrances"), F.min("width").alias("_narrow"))
    r = rooms.join(per, room, "left").join(steps, room, "left").fillna(0, ["ways", "_out", "entrances"])
    isolated, dead_end = F.col("ways") == 0, (F.col("ways") == 1) & (F.col("_out") == 0)
    likely = F.when(hub, 0.95).when(F.col("ways") >= 3, 0.7).when(dead_end | isolated, 0.05).otherwise(0.2)
    score = F.least(F.lit(100.0), F.col("ways") * 20 + likely * 40 + F.when(dead_end, 0).otherwise(20))
    access = F.when(isolated, "isolated").when(F.col("steps").isNull(), "unreachable").when(dead_end, "dead_end").otherwise("accessible")
    return r.select(room, "ways", "entrances", "steps", access.alias("access"), likely.alias("likelihood"), half_up(F.least("width", "_narrow"), 2).alias("clear_width"), F.when(isolated, 0.0).otherwise(F.floor(score + 0.5).cast("double")).alias("movement"))
