"""How filters interact: the order in which they run decides which of them removes a document, and what it costs.

With n filters there are 2^n subsets of filters already applied and n * 2^(n-1) edges (subset, next filter) of their
lattice; every one of the n! orders is a path over n such edges.  What a step removes depends on its edge alone, so
documents are counted on edges once, and the orders are read off by a join of edges with the steps of all paths.
Documents that fail the same filters count alike on every edge: they are first counted by (part, failures, labels),
so a shuffle moves at most 2^n rows of a part from each task, whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: n! paths are written out for each part.
MOST_FILTERS = 6

WORD = r"[^\x20\x09-\x0D]+"


def quality_filters(words: Column, text: Column) -> dict[str, Column]:
    """The four filters of the query, true where a text fails: short, repetitive, shouting, with markup signs."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _labels(labels: DataFrame) -> DataFrame:
    """One row per labelled document; of repeated labels any 1 counts."""
    good, toxic = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(good.alias("good"), toxic.alias("toxic"))


def _cells(docs: DataFrame, labels: DataFrame, filters, duplicates: str | None, part_col: str) -> tuple[DataFrame, list[str]]:
    """(part, mask, docs, good, toxic): documents by the set of filters that they fail, bit i for the i-th name."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")) if part_col else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", F.expr(f"regexp_extract_all(text, r'({WORD})', 0)").alias("words"))
    fails = filters(F.col("words"), F.col("text"))
    names = sorted([*fails, *([duplicates] if duplicates else [])])
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: every order of them is written out")
    bit = {name: 1 << i for i, name in enumerate(names)}
    mask = sum((F.when(c, bit[name]).otherwise(0) for name, c in fails.items()), F.lit(0))
    rows = rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("same"))
    # a row without id has no label; it goes around the join, where all such rows would be one key
    numbered = rows.where("doc_id is not null").join(_labels(labels), "doc_id", "left")
    numbered = numbered.groupBy("doc_id", "part", "mask", "same", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    nameless = rows.where("doc_id is null").groupBy("doc_id", "part", "mask", "same").agg(F.count("*").alias("n")).select("doc_id", "part", "mask", "same", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    rows = numbered.unionByName(nameless)
    if duplicates:
        # of equal texts only counts move: one row for each part and pair of labels
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
        alike = rows.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
        lead = F.min("first.doc_id").over(Window.partitionBy("same"))
        alike = alike.withColumn("kept", F.col("nameless") + F.when(F.col("first.doc_id") == lead, F.col("first.n")).otherwise(0))
        both = F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(bit[duplicates]).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
        rows = alike.select("part", "good", "toxic", F.inline(both))
    sums = [F.sum(F.col("n") * c).alias(name) for c, name in ((F.lit(1), "docs"), (F.col("good"), "good"), (F.col("toxic"), "toxic"))]
    return rows.groupBy("part", "mask").agg(*sums), names


def edges_of(cells: DataFrame, n: int) -> DataFrame:
    """What every cell of documents adds to every edge (applied, next) of the lattice, summed over the cells of a part."""
    all_edges = F.array(*[F.struct(F.lit(applied).alias("applied"), F.lit(i).alias("next")) for applied in range(1 << n) for i in range(n) if not applied >> i & 1])
    at = cells.select("part", "mask", "docs", "good", "toxic", F.inline(all_edges))
    bit = F.expr("shiftleft(1, next)")
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    of = lambda when, what="docs": F.sum(F.when(when, F.col(what)).otherwise(0))
    return at.groupBy("part", "applied", "next").agg(
        of(~fails & ~earlier).alias("kept"),
        of(fails & ~earlier).alias("removed"),
        of(fails & earlier).alias("redundant"),
        of(F.col("mask") == bit).alias("unique_fails"),
        of(fails & ~earlier, "good").alias("good_lost"),
        of(fails & ~earlier, "toxic").alias("toxic_lost"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, filters=quality_filters, duplicates: str | None = "E", part_col: str | None = "lang") -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps and removes, and what its filter is worth.

    ``filters`` gives named conditions of (words, text), true where a text fails; ``duplicates`` names the filter of
    texts that a smaller doc_id has too, wherever in the table; ``part_col`` splits the report.  Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is the empty one, a null part the empty string.  A row with a null doc_id has no label, is never a
    copy and makes none; rows of equal id and text are not copies of each other.  An empty table has no part and no
    row.  Other columns are not read.  Raises ValueError for more than six filters.
    """
    cells, names = _cells(docs, labels, filters, duplicates, part_col)
    n = len(names)
    edges = edges_of(cells, n)
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("applied") + 1)
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "next")))
    steps = []
    for order in permutations(range(n)):
        for k, i in enumerate(order):
            steps.append(("".join(names[x] for x in order), k + 1, sum(1 << x for x in order[:k]), i))
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")  # n * n! rows
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return edges.join(F.broadcast(steps), ["applied", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in longs])
