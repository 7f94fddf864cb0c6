"""Benchmark decontamination by greedy string tiling.

Seeds, the hashes of every ``min_match`` consecutive words of a benchmark item (of all words of a shorter one), are
joined with the documents' own;
for each document and item that share one, greedy string tiling finds passages in any order: repeatedly the
longest match of at least ``min_match`` words that overlaps no earlier one is marked, candidates found by
running Karp-Rabin hashes.  The share of an item's words that end up marked is its coverage.

Seeds of the benchmark are broadcast while they are fewer than ``broadcast_seeds``; beyond that documents' seeds
are shuffled and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, small_enough, stored, text_rows

WORD = re.compile(r"\w+")
_M = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words (letters, digits, underscore)."""
    words = WORD.findall(text.lower())
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def running(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _M + h[i : i + n]
    return out ^ (out >> np.uint64(31))


class _Words:
    """The words of one text: hashes of all runs of any length from their running sums, and which words are marked."""

    def __init__(self, h: np.ndarray, last: int) -> None:
        self.h, self.last, self.used = h, last, np.zeros(len(h), bool)
        self.sums, self.powers = np.zeros(len(h) + 1, np.uint64), np.ones(last + 1, np.uint64)
        np.multiply.accumulate(np.full(last, _M), out=self.powers[1:])
        np.cumsum(h * self.powers[: len(h)], out=self.sums[1:])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of k words none of which is marked."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate(([0], np.cumsum(self.used)))
        at = np.flatnonzero(taken[k:] == taken[:n])
        # each word was multiplied by its place's power; the power of what follows makes runs at all places comparable
        return at, (self.sums[at + k] - self.sums[at]) * self.powers[self.last - at]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, words), longest first; ties go to the earlier item place, then doc.

    The longest match of unmarked words is found by halving: if there is one of k words, there is one of every
    fewer.  Each try compares running hashes of that length, so time goes with the words of both texts, not with
    their product, however often words repeat.
    """
    if min_match < 1 or len(item) < min_match or len(doc) < min_match:
        return []
    last = max(len(item), len(doc))
    a, b = _Words(item, last), _Words(doc, last)
    found: list[tuple[int, int, int]] = []

    def shared(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (i, x), (j, y) = a.runs(k), b.runs(k)
        hit = np.isin(x, y)
        return i[hit], x[hit], j, y

    most = min(len(item), len(doc))
    while most >= min_match:
        low, high = min_match - 1, most  # there is a match of low words (or it is too few), none of more than high
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if len(shared(k)[0]) else (low, k - 1)
        if low < min_match:
            break
        i_at, x, j_at, y = shared(low)
        order = np.argsort(y, kind="stable")
        y, j_at = y[order], j_at[order]
        lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        for i, p, q in zip(i_at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            # earlier tiles are as long or longer: one that overlaps covers an end
            if a.used[i] or a.used[i + low - 1]:
                continue
            places = j_at[p:q]
            free = places[~(b.used[places] | b.used[places + low - 1])]
            if len(free) and (item[i : i + low] == doc[free[0] : free[0] + low]).all():
                j = int(free[0])
                found.append((i, j, low))
                a.used[i : i + low] = b.used[j : j + low] = True
        most = low - 1
    return found


def _seeds(h: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Distinct running hashes of each of these numbers of words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(running(h, k) for k in sizes)])).view(np.int64)


def _seed_table(items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """(item_key, k, seed, words, needed): every k consecutive words of an item; k is min_match, or the words of a
    shorter item; words are those that the seed's places in the item can cover, needed those that count as found."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes, needed, flat, words = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(text)
                k = min(min_match, len(h))
                seeds, times = np.unique(running(h, k) if k else h, return_counts=True)
                keys += [key] * len(seeds)
                sizes += [k] * len(seeds)
                needed += [coverage * len(h)] * len(seeds)
                flat.append(seeds.view(np.int64))
                words.append(times * k)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), join(flat), join(words), pa.array(needed, pa.float64())], names=["item_key", "k", "seed", "words", "needed"])

    return items.select("item_key", "text").mapInArrow(each, "item_key long, k int, seed long, words long, needed double").distinct()


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    min_match: int = 5,
    coverage: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_seeds: int = 2_000_000,
) -> DataFrame:
    """One row per document and item whose coverage is reached: doc_id, key, item_id, coverage, n_tiles, longest.

    key is xxhash64 of the text, so that rows that repeat a doc_id with another text are told apart; equal rows
    give one result row.  Null texts are empty and match nothing; an item shorter than min_match words is
    found where all its words stand in a row; a null item_id is kept, as items are told apart by their text; a null doc_id is kept; empty tables give no rows; other columns are ignored.
    """
    docs = text_rows(documents, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).withColumn("item_key", F.xxhash64("text"))
    seeds = stored(_seed_table(items, min_match, coverage), "seeds")
    n_seeds = seeds.count()
    sizes = sorted(r["k"] for r in seeds.select("k").distinct().collect())  # one, or a few if there are short items
    if n_seeds <= broadcast_seeds:
        candidates = _by_broadcast(docs, seeds, sizes)
    else:
        candidates = _by_shuffle(docs, seeds, sizes)
    # only pairs whose shared seeds could cover enough of the item; items join by a key of their text
    pairs = candidates.join(items.select("item_key", "item_id", F.col("text").alias("item")).distinct(), "item_key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for doc_id, key, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = word_hashes(item)
                found = tiles(a, word_hashes(text), min(min_match, len(a)))
                covered = sum(n for _, _, n in found)
                if len(a) and covered >= coverage * len(a):
                    out.append({"doc_id": doc_id, "key": key, "item_id": item_id, "coverage": covered / len(a), "n_tiles": len(found), "longest": found[0][2]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())]))

    return pairs.select("doc_id", "key", "text", "item_id", "item").mapInArrow(each, "doc_id long, key long, item_id long, coverage double, n_tiles int, longest int").distinct()


def _by_broadcast(docs: DataFrame, seeds: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents with the items they share a seed with; the seeds, at most broadcast_seeds, go to every task."""
    table = seeds.orderBy("seed").toPandas()
    known = docs.sparkSession.sparkContext.broadcast((table["seed"].to_numpy(np.int64), table["item_key"].to_numpy(np.int64), table["words"].to_numpy(np.int64), table["needed"].to_numpy(np.float64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, item, words, needed = known.value
        for batch in sliced(batches):
            rows, items = [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                h = _seeds(word_hashes(text), sizes)
                at = np.minimum(np.searchsorted(seed, h), max(0, len(seed) - 1))
                hit = h[seed[at] == h] if len(seed) and len(h) else h[:0]
                if len(hit):
                    lo, hi = np.searchsorted(seed, hit, "left"), np.searchsorted(seed, hit, "right")
                    places = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                    found, first, which = np.unique(item[places], return_index=True, return_inverse=True)
                    found = found[np.bincount(which, weights=words[places]) >= needed[places][first] - 1e-9]
                    rows += [r] * len(found)
                    items += found.tolist()
            took = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*took, pa.array(items, pa.int64())], names=["doc_id", "key", "text", "item_key"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(each, "doc_id long, key long, text string, item_key long")


def _by_shuffle(docs: DataFrame, seeds: DataFrame, sizes: list[int]) -> DataFrame:
    """The same through a shuffle of the documents' distinct seeds, for benchmarks too large to broadcast."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.drop_duplicates(["doc_id", "key"])
            own = [_seeds(word_hashes(t), sizes) for t in f["text"]]
            n = [len(x) for x in own]
            yield pd.DataFrame({"doc_id": f["doc_id"].repeat(n).array, "key": f["key"].repeat(n).array, "seed": np.concatenate(own) if own else np.zeros(0, np.int64)})

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = keyed.mapInPandas(each, "doc_id long, key long, seed long").join(seeds, "seed").groupBy("doc_id", "key", "item_key").agg(F.sum("words").alias("words"), F.max("needed").alias("needed")).where("words >= needed - 1e-9")
    d, f = keyed.alias("d"), found.alias("f")
    return d.join(f, F.expr("d.key = f.key and d.doc_id <=> f.doc_id")).select("d.doc_id", "d.key", "d.text", "f.item_key")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    bad = stored(contaminated(documents, benchmark, **options).select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct(), "leaks")
    if small_enough(bad, 1_000_000):  # two numbers a row
        bad = F.broadcast(bad)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = F.xxhash64(F.coalesce(documents[text_col], F.lit("")))
    return documents.join(bad, documents[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"]), "left_anti")
