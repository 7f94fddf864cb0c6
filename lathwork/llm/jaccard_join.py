"""N-gram Jaccard join by grouped prefixes.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold.  Steps:

1. A frequency sketch of fixed size (shingle hash buckets counted over all rows, summed on the JVM) ranks shingles
   from rare to common.  Any deterministic ranking keeps the prefix filter exact, so a sketch is enough.
2. One row per document: set size, digest of the set, and the prefix (the rarest shingles of which two linked
   sets must share one).  Equal sets collapse to a class, classes of equal prefix and size to a group.
3. Groups that share a prefix shingle are compared with one of its groups only, that with the fewest rarer shingles (a number of pairs in
   proportion to the postings), filtered by size and position, expanded to class representatives, filtered by the
   most that two sets of such counts by bucket can share, and verified on whole texts; components of the verified
   links follow.
4. What is left are pairs that share a prefix shingle and lie in different components.  All of these are verified
   too, so that no link between components is lost, while a hot group of copies never becomes all its pairs.

The 64-bit shingle hash is xxh3 of the words, mixed; sets are told apart by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import removed, sliced, small_enough, stored, text_keys, text_rows, tidy

SKETCH_BITS = 20
SKETCH_WIDTH = 256
COUNT_BITS = 7  # a set's shingles are counted in 2**7 buckets of a byte each
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of all shingles in order, repeats included.  bytes.lower() changes A-Z only; bytes.split() cuts at
    \\x20 and \\x09-\\x0D.  A text of fewer words is one shingle; no words, none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    if not k:
        return h
    n, out = len(h) - k + 1, np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * M1
        out ^= out >> np.uint64(32)
    out = out * M2
    return out ^ (out >> np.uint64(29))


def frequency_rank(docs: DataFrame, words: int) -> np.ndarray:
    """Rank of every hash bucket by its count over all documents.  2**20 buckets whatever the input: 4 MB to broadcast."""
    size = 1 << SKETCH_BITS
    names = [f"c{i}" for i in range(SKETCH_WIDTH)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(size, np.int64), [], 0

        def add() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held).astype(np.int64), minlength=size)
                held.clear()

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingle_hashes(text, words) & np.uint64(size - 1))
                waiting += len(held[-1])
                if waiting > size:
                    add()
                    waiting = 0
        add()
        grid = total.reshape(-1, SKETCH_WIDTH)
        rows = np.flatnonzero(grid.any(axis=1))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(grid[rows, i]) for i in range(SKETCH_WIDTH))], names=["r", *names])

    parts = docs.select("text").mapInArrow(count, "r int, " + ", ".join(f"{c} long" for c in names))
    total = parts.groupBy("r").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    counts = np.zeros((size // SKETCH_WIDTH, SKETCH_WIDTH), np.int64)
    if len(total):
        counts[total["r"].to_numpy()] = total[names].to_numpy()
    rank = np.empty(size, np.uint64)
    rank[np.argsort(counts.ravel(), kind="stable")] = np.arange(size, dtype=np.uint64)
    return rank.astype(np.uint32)


def needed_overlap(n: int, percent: int) -> int:
    """The smallest intersection with any linked partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, key, check, n, cid, g, prefix, counts): key and check find the text again, cid is the set's digest, g the
    group's number, counts how many shingles fall into each bucket (null if one has more than a byte holds)."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(frequency_rank(docs, words))
    mask, top, few = np.uint64((1 << SKETCH_BITS) - 1), np.uint64(64 - SKETCH_BITS), np.uint64((1 << COUNT_BITS) - 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in sliced(batches):
            n, cid, g, flat, ends, counts = [], [], [], [], [0], []
            for text in batch.column(3).to_pylist():
                h = shingle_hashes(text, words)
                # a bijection of the hash that sorts by rank first
                h = (order[(h & mask).astype(np.int64)].astype(np.uint64) << top) | (h >> np.uint64(SKETCH_BITS))
                h.sort()
                if len(h) > 1:
                    h = h[np.concatenate(([True], h[1:] != h[:-1]))]
                n.append(len(h))
                cid.append(xxhash.xxh3_128_digest(h.tobytes()))
                p = h[: len(h) - needed_overlap(len(h), percent) + 1] if len(h) else h
                g.append(xxhash.xxh3_64_intdigest(p.tobytes() + len(h).to_bytes(8, "little")) - (1 << 63))
                buckets = np.bincount((h & few).astype(np.int64), minlength=1 << COUNT_BITS)
                counts.append(buckets.astype(np.uint8).tobytes() if buckets.max() < 256 else None)
                flat.append(p.view(np.int64))
                ends.append(ends[-1] + len(p))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(g, pa.int64()), lists, pa.array(counts, pa.binary())], names=["doc_id", "key", "check", "n", "cid", "g", "prefix", "counts"])

    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(each, "doc_id long, key long, check long, n long, cid binary, g long, prefix array<long>, counts binary")


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes fit, and the overlap is still possible when this shared shingle is the first at both positions."""
    least = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent}D - 1e-9)"
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) "
        f"and least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {least}"
    )


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs of classes those that can link: two sets share at most the lesser count of each bucket, summed."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            known = np.logical_and(*(c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[4:6]))
            x, y = (np.frombuffer(b"".join(v for v, k in zip(c.to_pylist(), known, strict=True) if k), np.uint8).reshape(-1, 1 << COUNT_BITS) for c in batch.columns[4:6])
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.full(batch.num_rows, np.iinfo(np.int64).max)
            most[known] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep = most >= -(-size * percent // (100 + percent))  # shared shingles needed, a whole number
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("counts").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(bound, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (a, b) pairs of classes those whose whole texts link, stored; sets has the keys of one text of each class."""
    pairs = stored(_possible(pairs, sets, percent), "possible")
    wanted = stored(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(sets, "cid").select("cid", "key", "check"), "wanted")
    few = F.broadcast(wanted) if small_enough(wanted, 500_000) else wanted
    texts = docs.select(*text_keys(F.col("text")), "text").join(few, ["key", "check"]).dropDuplicates(["cid"]).select("cid", "text")
    texts = stored(texts, "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def shingles(text: str) -> np.ndarray:
            return np.unique(shingle_hashes(text, words))

        for batch in sliced(batches):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = shingles(x), shingles(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("y"))
    found = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"), "links")
    removed(pairs, wanted, texts)
    return found


def _all_candidates(postings: DataFrame, classes: DataFrame, percent: int, salts: int = 16) -> DataFrame:
    """(a, b): all pairs of classes, a < b, that share a prefix shingle or a group; each list is dealt over ``salts`` tasks."""
    salt = F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    lists = stored(postings.select("token", "g", "n", "pos").join(classes.select("g", "cid"), "g").select("token", "cid", "n", "pos"), "lists")
    x, y = lists.select("*", salt).alias("x"), lists.select("*", every).alias("y")
    shared = x.join(y, F.expr("x.token = y.token and x.salt = y.salt and x.cid < y.cid and " + _may_link("x", "y", percent))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    u, v = classes.select("g", "cid", salt).alias("u"), classes.select("g", "cid", every).alias("v")
    within = u.join(v, F.expr("u.g = v.g and u.salt = v.salt and u.cid < v.cid")).select(F.col("u.cid").alias("a"), F.col("v.cid").alias("b"))
    return shared.union(within).distinct()


def jaccard_components(documents: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", exact_links: bool = False) -> DataFrame:
    """One row per input row: doc_id, key (xxhash64 of the text), n_shingles, component_id, class_id (hex
    digest of the shingle set), n_links.

    component_id is the smallest doc_id reachable by links; n_links counts the verified links of the document's
    class with other classes.  With exact_links it counts all links there are; without, links inside a component
    that were not needed to find it are not verified, so it is a lower bound.  Null or wordless texts have an empty set and link with nothing.  Rows that repeat a
    doc_id each get a row.  A null doc_id is kept and never is a component's id unless all its ids are null.
    An empty table gives no rows; other columns are ignored.
    """
    docs = text_rows(documents, id_col, text_col)
    rows = stored(prefixes(docs, words, percent), "prefixes")
    classes = stored(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("g", "n", "key", "check", "counts")).alias("s"), F.count("*").alias("copies")).select("cid", "first_id", "s.*"), "classes")
    # one prefix for each group
    groups = rows.where("n > 0").select("g", "n", "prefix").groupBy("g", "n").agg(F.min("prefix").alias("prefix"))
    postings = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    # most shingles of a prefix occur in it only: they are counted out first, as bare numbers
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    postings = stored(postings.join(shared, "token"), "shared")
    pivots = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "g")).alias("pivot"), F.count("*").alias("df"))
    postings = stored(postings.join(pivots, "token"), "postings")
    leaders = classes.groupBy("g").agg(F.min("cid").alias("leader"), F.count("*").alias("size"))
    spoken = stored(leaders, "leaders")

    p = postings.select("token", F.struct("g", "n", "pos").alias("m"), "pivot").where("m.g <> pivot.g").where(_may_link("m", "pivot", percent))
    pairs = p.select(F.col("m.g").alias("g1"), F.col("pivot.g").alias("g2")).distinct()
    pairs = pairs.join(spoken.select(F.col("g").alias("g1"), F.col("leader").alias("a")), "g1").join(spoken.select(F.col("g").alias("g2"), F.col("leader").alias("b")), "g2").select("a", "b")
    inside = classes.join(spoken, "g").where("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    pairs = stored(pairs.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = _verified(pairs, classes, docs, words, percent)
    tidy(docs.sparkSession)
    label = components(links)

    # the rest: pairs in different components that share a prefix shingle or a group
    named = stored(classes.select("cid", "g", "n").join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "g", F.coalesce("label", "cid").alias("label")), "named")
    # a list of two groups of one class each has no pair but the one that is checked
    crowded = postings.where("df = 2").join(spoken.where("size > 1"), "g", "left_semi").select("token").distinct()
    open_lists = postings.where("df > 2").unionByName(postings.where("df = 2").join(crowded, "token", "left_semi").select(*postings.columns))
    lists = open_lists.select("token", "g", "n", "pos").join(named, "g")
    mixed = lists.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    lists = stored(lists.join(mixed, "token"), "mixed")
    x, y = lists.alias("x"), lists.alias("y")
    rest = x.join(y, F.expr("x.token = y.token and x.cid < y.cid and x.label <> y.label and " + _may_link("x", "y", percent))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    u, v = named.alias("u"), named.alias("v")
    within = u.join(v, F.expr("u.g = v.g and u.cid < v.cid and u.label <> v.label")).select(F.col("u.cid").alias("a"), F.col("v.cid").alias("b"))
    rest = stored(rest.union(within).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    tidy(docs.sparkSession)
    more = _verified(rest, classes, docs, words, percent)
    links = links.union(more)
    label = components(links)
    if exact_links:
        inner = stored(_all_candidates(postings, classes, percent).join(pairs.union(rest), ["a", "b"], "left_anti"), "inner")
        links = links.union(_verified(inner, classes, docs, words, percent))
    degree = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count("*").alias("n_links"))
    known = classes.select("cid", "first_id").join(label.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first_id", F.coalesce("label", "cid").alias("label"))
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = stored(known.join(least, "label").join(degree, "cid", "left").select("cid", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    return rows.select("doc_id", "key", "n", "cid").join(known, "cid", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.lower(F.hex("cid")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
