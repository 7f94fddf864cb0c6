"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized once in Arrow batches; each becomes pieces of at most ``capacity`` tokens (only longer
documents are cut; the first piece takes the remainder).  The small table of pieces is stored, dealt round-robin
into shards of a bounded number of pieces (more input means more shards, not larger ones), and every shard is
packed on its own: best fit over decreasing lengths, then local search between the bins that are not full.  A
shard wastes at most a few bins, which is small against the thousands it fills.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import sliced, stored, text_rows

END_ID = 0
SHARD_PIECES = 40_000


def pieces(documents: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of a text, then id 0, cut at ``capacity`` from the end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in sliced(batches, keep="tokens"):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data = np.append(ids, END_ID).astype("<u4").tobytes()
                n = len(data) >> 2
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(data[4 * cuts[k] : 4 * cuts[k + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_rows(documents, id_col, text_col).mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it (the oldest of equals)."""
    open_bins: dict[int, list[int]] = {}  # room -> bins with that room
    rooms: list[int] = []  # sorted rooms that occur
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(rooms, lengths[i])
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - lengths[i]:
            if left not in open_bins:
                open_bins[left] = []
                insort(rooms, left)
            open_bins[left].append(b)
    return bins


class _Targets:
    """Underfull bins by what they can hand back: for every number of tokens t, the rooms of the bins that can give up t.

    ``next[k][t, d]`` is the smallest room of at least d among bins that can give up t tokens in at most one piece
    (k = 0, t = 0 for none) or in two (k = 1).  16 MB of 16-bit numbers at a capacity of 2,048.
    """

    def __init__(self, capacity: int):
        self.capacity, self.none = capacity, capacity + 1
        kind = np.int16 if self.none < 1 << 15 else np.int32
        self.next = [np.full((capacity + 1, capacity + 2), self.none, kind) for _ in range(2)]
        self.bins: dict[tuple[int, int, int], dict[int, None]] = {}

    def add(self, b: int, room: int, gives: list[tuple[int, int]]) -> None:
        for k, t in gives:
            if same := self.bins.get((k, t, room)):
                same[b] = None
                continue
            self.bins[k, t, room] = {b: None}
            row = self.next[k][t]
            row[int(row[: room + 1].searchsorted(room, "right")) : room + 1] = room

    def drop(self, b: int, room: int, gives: list[tuple[int, int]]) -> None:
        for k, t in gives:
            same = self.bins[k, t, room]
            del same[b]
            if not same:
                del self.bins[k, t, room]
                row = self.next[k][t]
                row[int(row[: room + 1].searchsorted(room, "left")) : room + 1] = row[room + 1]

    def best(self, room: int, ones: list[int], twos: list[int]) -> tuple[int, int, int, int, int] | None:
        """(tokens given, kind given, bin, tokens taken, kind taken) that raises squared fill most for a source of that room."""
        most, found, wide = 0, None, self.capacity + 2
        for kind, given, takes in ((0, ones, (0, 1)), (1, twos, (0,))):
            for g in given:
                d = np.arange(g, 0, -1)  # tokens moved, if 0, 1, ... are taken in turn
                for k in takes:
                    to = self.next[k].ravel()[g : g * (wide - 1) + 1 : wide - 1]  # next[k][t, g - t]
                    raised = np.where(to < self.none, d * (room + d - to), 0)
                    t = int(raised.argmax())
                    if raised[t] > most:
                        most, found = int(raised[t]), (g, kind, next(iter(self.bins[k, t, int(to[t])])), t, k)
        return found


def _of(pieces: list[int], lengths: list[int], tokens: int, kind: int) -> list[int]:
    """Pieces of a bin with that many tokens: none or one (kind 0), or two (kind 1)."""
    if not tokens:
        return []
    first = {lengths[i]: i for i in reversed(pieces)}
    if not kind:
        return [first[tokens]]
    for i in pieces:
        for j in pieces if 2 * lengths[i] == tokens else [first.get(tokens - lengths[i], i)]:
            if i != j and lengths[i] + lengths[j] == tokens:
                return [i, j]
    raise AssertionError("no two pieces of so many tokens")


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves, one-for-one, one-for-two and two-for-one exchanges until none between any two bins raises the sum of squared fills.

    Every underfull bin is a source, the emptiest first, and every other one a target.  A source takes the exchange that
    raises squared fill most, again and again, until it has none or is empty and goes; passes over the sources end
    with one in which nothing moved.  Exchanges are found by tokens and room, not bin by bin (_Targets); a bin has
    few different lengths (63 at most in 2,048 tokens), however many its pieces.  Full bins can't take part: what
    they gave would lower squared fill.
    """
    bins = [list(b) for b in bins]
    room = [capacity - sum(lengths[i] for i in b) for b in bins]

    def sums(b: int) -> tuple[list[int], list[int]]:
        count = Counter(lengths[i] for i in bins[b])
        ones = sorted(count, reverse=True)
        return ones, sorted({x + y for n, x in enumerate(ones) for y in ones[n if count[x] > 1 else n + 1 :]}, reverse=True)

    def gives(ones: list[int], twos: list[int]) -> list[tuple[int, int]]:
        return [(0, 0), *((0, t) for t in ones), *((1, t) for t in twos)]

    under = [b for b in range(len(bins)) if bins[b] and room[b] > 0]
    if len(under) < 2:
        return [b for b in bins if b]
    targets, known = _Targets(capacity), {b: sums(b) for b in under}
    for b in under:
        targets.add(b, room[b], gives(*known[b]))
    moved = True
    while moved:
        moved = False
        for s in sorted(known, key=lambda b: (-room[b], b)):
            if s not in known:  # filled since
                continue
            targets.drop(s, room[s], gives(*known[s]))
            while bins[s] and (step := targets.best(room[s], *known[s])):
                given, kind, t, taken, back = step
                targets.drop(t, room[t], gives(*known[t]))
                give, take = _of(bins[s], lengths, given, kind), _of(bins[t], lengths, taken, back)
                bins[s] = [i for i in bins[s] if i not in give] + take
                bins[t] = [i for i in bins[t] if i not in take] + give
                room[s] += given - taken
                room[t] -= given - taken
                known[s], known[t], moved = sums(s), sums(t), True
                if room[t]:
                    targets.add(t, room[t], gives(*known[t]))
                else:
                    del known[t]
            if bins[s]:
                targets.add(s, room[s], gives(*known[s]))
            else:
                del known[s]
    return [b for b in bins if b]


def pack(documents: DataFrame, vocabulary: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone; a null doc_id is kept; repeated rows are packed each
    for itself; ties go by input order, so the result is one of several of equal size; an empty table gives no
    rows; other columns are ignored.
    """
    found = stored(pieces(documents, vocabulary or tokens.default_vocabulary(), capacity, id_col, text_col), "pieces")
    shards = max(1, -(-found.count() // SHARD_PIECES))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        lengths = rows.column("length").to_pylist()
        packed = improve(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(packed):
            at = 0
            for i in b:
                sequence[i], offset[i] = (shard << 32) | k, at
                at += lengths[i]
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.repartition(shards).mapInArrow(each, schema)
