"""Openings from hierarchies: assemblies below the topmost node of a telling name, openings that repeat, rooms that are one.

The topmost node is found by pointer doubling: every node knows the topmost telling one among its next 1, 2, 4 ...
ancestors, so a tree of any depth takes as many rounds as its depth has binary digits, and no round goes level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from . import boundaries, graph, grid
from .graph import settled

# fixed values: names that tell an opening, and words of the parts in it
TELLING = r"(?i)\b(?:p\d{4,}|j\d{4,}|pintu|door|jendela|window)\b"
ROLES = {"leaf": "(?i)daun|leaf|panel", "frame": "(?i)kusen|frame|mullion|sash", "glass": "(?i)kaca|glass|glaz", "trim": "(?i)trim|list|sill|threshold|handle|pegangan"}
# fixed values: shares, metres
SAME_PLAN, SAME_PLACE, LEVEL, HEIGHT, GAP, LEAST_SHARED, DECLARED_GAP = 0.8, 0.12, 0.15, 0.35, 0.08, 0.2, 0.12
#: width of the cells of openings' centres: only one in some fifteen is near a border, and few openings of a model are in one
CELL = 32 * SAME_PLACE


def telling(name: Column) -> Column:
    """Whether a node's name says that it is a door or a window."""
    return F.coalesce(F.regexp_replace(name, "[_-]+", " ").rlike(TELLING), F.lit(False))


def topmost(nodes: DataFrame, node: str, parent: str, flag: str, most_rounds: int = 40) -> DataFrame:
    """(node, top): the highest flagged node among each node and its ancestors, null if there is none.

    A parent that is no node ends a path.  Nodes are distinct; a path that never ends is an error.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(node)).alias("top"))
    # a parent that does not exist is none
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("_there"))
    rows = settled(rows.join(known, "up", "left").select("node", F.when(F.col("_there"), F.col("up")).alias("up"), "top"))
    for _ in range(most_rounds):
        open_rows = rows.where("up is not null")
        if open_rows.isEmpty():
            return rows.select("node", "top")
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        # what a higher stretch has found is above what a lower one has
        moved = open_rows.join(above, "up").select("node", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"))
        rows = settled(rows.where("up is null").unionByName(moved))
    raise ValueError("a node is its own ancestor")


def opening_assemblies(nodes: DataFrame) -> DataFrame:
    """One row per assembly: node, name, n_nodes (with its own), meshes of all nodes below, and those of leaf, frame, glass and trim (sorted arrays).

    ``nodes``: node (distinct), parent, name, mesh (null for none).  An assembly is a node of a telling name without such an
    ancestor; a node counts for a part if its own name says so.  Null names tell nothing.
    """
    n = nodes.select("node", "parent", "name", "mesh", telling(F.col("name")).alias("_tells"))
    low = n.join(topmost(n, "node", "parent", "_tells"), "node").where("top is not null")
    below = F.col("node") != F.col("top")
    of = lambda when: F.array_sort(F.collect_set(F.when(below & when, F.col("mesh"))))
    parts = [of(F.coalesce(F.col("name").rlike(p), F.lit(False))).alias(role) for role, p in ROLES.items()]
    out = low.groupBy("top").agg(F.max(F.when(~below, F.col("name"))).alias("name"), F.count("*").alias("n_nodes"), of(F.lit(True)).alias("meshes"), *parts)
    return out.withColumnRenamed("top", "node")


def distinct_openings(openings: DataFrame) -> DataFrame:
    """(id, of): each opening, with the one kept that it repeats, null for those kept.

    ``openings``: model, id (distinct), kind, name_score, area, bounds x0 .. z1 (numbers).  Two are like if their kinds agree, they share 0.8
    of the smaller plan, and centres and sizes differ by 0.12 at most.  Taken by name score, then area, then id; one that is
    like an earlier kept one repeats the first of these.
    """
    ends = [f"{a}{e}" for a in "xyz" for e in "01"]
    o = openings.select("model", "kind", "id", (-F.col("name_score")).alias("score"), (-F.col("area")).alias("area"), *ends).where(" and ".join(f"{c} is not null" for c in ["id", *ends]))
    # centres of like ones are in one cell or just over its border: an opening stands in its cell and asks in those that it is near to
    cell = lambda a, d: F.floor(((F.col(f"{a}0") + F.col(f"{a}1")) / 2 + d) / CELL).cast("long")
    home, asks = o, o
    for a in "xyz":
        home = home.withColumn(f"c{a}", cell(a, 0.0))
        asks = asks.withColumn(f"c{a}", F.explode(F.sequence(cell(a, -1.01 * SAME_PLACE), cell(a, 1.01 * SAME_PLACE))))
    met = asks.alias("a").join(home.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("model", "kind", "cx", "cy", "cz")])
    c = lambda s, a, e: F.col(f"{s}.{a}{e}")
    size = lambda s, a: c(s, a, 1) - c(s, a, 0)
    shared = lambda a: F.greatest(F.lit(0.0), F.least(c("a", a, 1), c("b", a, 1)) - F.greatest(c("a", a, 0), c("b", a, 0)))
    plan = lambda s: size(s, "x") * size(s, "z")
    away = [(c("a", a, 0) + c("a", a, 1)) / 2 - (c("b", a, 0) + c("b", a, 1)) / 2 for a in "xyz"]
    like = (shared("x") * shared("z") / F.greatest(F.least(plan("a"), plan("b")), F.lit(0.001)) >= SAME_PLAN) & (F.sqrt(sum((d * d for d in away[1:]), away[0] * away[0])) <= SAME_PLACE)
    like = like & (F.greatest(*(F.abs(size("a", a) - size("b", a)) for a in "xyz")) <= SAME_PLACE)
    for a in "xyz":
        like = like & (c("a", a, 0) - c("b", a, 1) <= SAME_PLACE) & (c("b", a, 0) - c("a", a, 1) <= SAME_PLACE)
    rank = lambda s: F.struct(F.col(f"{s}.score").alias("a"), F.col(f"{s}.area").alias("b"), F.col(f"{s}.id").alias("c"))
    # each like pair once, the earlier one first
    later = settled(met.where(like & (rank("a") < rank("b"))).select(rank("a").alias("rank"), F.col("b.id").alias("then")))
    lost = boundaries.lost_in_order(later.select(F.col("rank.c").alias("first"), "then"))
    kept = later if lost is None else later.join(lost.withColumnRenamed("id", "_lost"), F.col("rank.c") == F.col("_lost"), "left_anti")
    # whatever has a kept one before it is lost, and what is kept has none
    first = kept.groupBy(F.col("then").alias("id")).agg(F.min("rank")["c"].alias("of"))
    return openings.select("id").join(first, "id", "left").select("id", "of")


def merged_rooms(rooms: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One row per group of room candidates that are one room: room (smallest id), members (sorted), area, floor, height, volume, coverage, walls, state.

    ``rooms``: group (parent), id (distinct), floor, height, area, coverage, walls (count), evaluated (whether its boundaries were
    looked at), x0, x1, z0, z1; ``shared`` (optional): a, b, gap, overlap, walls between - what is declared of a pair.  Two
    rooms of a group are one if floors are within 0.15 and heights within 0.35, and they are declared to adjoin without a wall
    between, or, where nothing is declared and neither was evaluated, their plans adjoin.  Order does not matter.
    """
    fields = ["floor", "height", "evaluated", "x0", "x1", "z0", "z1"]
    r = settled(rooms.select("group", "id", "area", "coverage", "walls", *fields))
    near = grid.touching(r, ["group"], "id", ("x", "z"), GAP, fields)
    level = (F.abs(F.col("a_floor") - F.col("b_floor")) <= LEVEL) & (F.abs(F.col("a_height") - F.col("b_height")) <= HEIGHT)
    reach = lambda k: F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0")
    apart = lambda k: F.greatest(F.lit(0.0), -reach(k))
    adjoin = ((apart("x") <= GAP) & (reach("z") >= LEAST_SHARED)) | ((apart("z") <= GAP) & (reach("x") >= LEAST_SHARED))
    plain = near.where(level & adjoin & ~F.col("a_evaluated") & ~F.col("b_evaluated")).select("a", "b")
    if shared is not None:
        d = shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "gap", "overlap", "walls").where("a <> b")
        # of a pair declared by both sides the smaller one's word counts
        d = d.groupBy("a", "b").agg(F.min(F.struct("gap", "overlap", "walls")).alias("d"))
        side = lambda s: r.select(F.col("id").alias(s), F.col("group").alias(f"{s}_group"), F.col("floor").alias(f"{s}_floor"), F.col("height").alias(f"{s}_height"))
        said = d.join(side("a"), "a").join(side("b"), "b").where(F.col("a_group").eqNullSafe(F.col("b_group")) & level)
        said = said.where((F.col("d.gap") <= DECLARED_GAP) & (F.col("d.overlap") >= LEAST_SHARED) & (F.col("d.walls") == 0)).select("a", "b")
        plain = plain.join(d, ["a", "b"], "left_anti").unionByName(said)
    found = graph.connected_components(plain).select(F.col("node").alias("id"), F.col("component").alias("room"))
    rows = r.join(found, "id", "left").withColumn("room", F.coalesce("room", "id"))
    total = F.sum("area")
    mean = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("area")) / total).otherwise(0.0)
    out = rows.groupBy("group", "room").agg(F.array_sort(F.collect_list("id")).alias("members"), total.alias("area"), mean("floor").alias("floor"), mean("height").alias("height"), F.min("coverage").alias("coverage"), F.sum("walls").alias("walls"))
    state = F.when((F.col("height") > 0) & (F.col("walls") > 0), "valid").otherwise("incomplete boundary")
    return out.withColumn("volume", half_up(F.col("area") * F.col("height"), 6)).withColumn("state", state)
