"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and the first three to seven characters of longer ones, so that
inflected forms meet, and for beginnings that two, or four, of its words share one more each; all are hashed into
2**19 places.  The machine adds a weight for each term and, for each pair of terms,
the inner product of their factors: what an insult and a group mention say together, neither says alone.

    y = bias + sum of s_i w_i + ((sum of v_i)^2 - sum of v_i^2) / (2 n),   score = 1 / (1 + exp(-y)),   n = terms that the model knows

The model knows every term that enough rows hold, whatever it says by itself, so that pairs of terms that are neutral
one by one are learned.  Only a term's own weight is held back, by s_i, which goes from nought to one with the
evidence that the term alone tells the labels apart.

It is fitted by AdaGrad on at most ``max_train_rows`` labelled rows (those of smallest doc_id hash), in one task;
scoring is one pass over all texts with 10 MB of weights broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, sliced, small_batches, stored, text_keys, text_rows

BITS, FACTORS, MEMO = 19, 4, 150_000
BEGINNINGS, OFTEN = range(3, 8), (2, 4)
WORD = re.compile(r"[^\W_]+")


class Terms(dict):
    """Word to the bytes of its places; bounded."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        terms = [word] + [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]
        self[word] = got = np.array([xxhash.xxh3_64_intdigest(t) & ((1 << BITS) - 1) for t in terms], np.int32).tobytes()
        return got


_TERMS = Terms()
KEPT["terms"] = _TERMS.clear


def term_places(text: str) -> np.ndarray:
    """The distinct places of a text's terms, sorted; none for a text without words."""
    words = set(WORD.findall(text.lower()))
    places, counts = np.unique(np.frombuffer(b"".join(map(_TERMS.__getitem__, words)), np.int32), return_counts=True)
    often = [(places[counts >= k].astype(np.int64) * 2654435761 + k >> 7 & (1 << BITS) - 1).astype(np.int32) for k in OFTEN]
    return np.unique(np.concatenate((places, *often)))


def term_statistics(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By term, the rows that hold it, and how many standard errors its shares under the two labels lie apart."""
    size, ones = 1 << BITS, max(1.0, float(labels.sum()))
    noughts = max(1.0, len(labels) - ones)
    seen, with_one = np.zeros(size), np.zeros(size)
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        flat, marks = np.concatenate(part), np.repeat(labels[i : i + 256], [len(r) for r in part])
        seen += np.bincount(flat, minlength=size)
        with_one += np.bincount(flat, weights=marks, minlength=size)
    p = np.clip(seen / (ones + noughts), 1e-9, 1 - 1e-9)
    return seen, (with_one / ones - (seen - with_one) / noughts) / np.sqrt(p * (1 - p) * (1 / ones + 1 / noughts))


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 10, rate: float = 0.3, pair_rate: float = 0.1, least_rows: int = 3, half_z: float = 3.0, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors.  Terms in fewer than ``least_rows`` rows stay at nought; all others take part in pairs.
    A term's own weight counts by z^4 / (z^4 + half_z^4), z its standard errors from telling nothing."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    seen, z = term_statistics(rows, labels)
    known, own = seen >= least_rows, z**4 / (z**4 + half_z**4)
    rows = [r[known[r]] for r in rows]
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)) * known[:, None]
    gw, gv, bias, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 0.0, 1e-2
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            n = max(1, len(at))
            vs, share = v[at], own[at]
            total = vs.sum(axis=0)
            y = bias + w[at] @ share + (total @ total - (vs * vs).sum()) / (2 * n)
            err = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[i]
            if abs(err) < 1e-3:
                continue
            gb += err * err
            bias -= rate * err / np.sqrt(gb)
            g = err * share + 3e-3 * w[at]
            gw[at] += g * g
            w[at] -= rate * g / np.sqrt(gw[at])
            g = err * (total - vs) / n + 1e-2 * vs
            gv[at] += g * g
            v[at] -= pair_rate * g / np.sqrt(gv[at])
    return bias, (w * own).astype(np.float32), v.astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, max_train_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[float, np.ndarray, np.ndarray]:
    """The model from labelled rows with crc32(doc_id) mod 5 not 0.  Of labels that differ on one doc_id the largest
    counts, of rows that repeat one the text of smallest hash.  Without labelled rows the model says 0.5 for all."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    few = F.broadcast(stored(marks, "labels"))  # at most max_train_rows rows of two numbers

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, keep="terms"):
            found = [term_places(t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "places", "y"])

    one = text_rows(documents, id_col, text_col).join(few, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    rows = stored(one.mapInArrow(places, "doc_id long, places array<int>, y int"), "training")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            ends, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            got += [(d, flat[i:j], y) for d, i, j, y in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], b.column(2).to_pylist(), strict=True)]
        got.sort(key=lambda r: (r[0], len(r[1])))
        bias, w, v = train([p for _, p, _ in got], np.array([float(y) for _, _, y in got]))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()]), pa.array([v.tobytes()])], names=["bias", "w", "v"])

    model = rows.coalesce(1).mapInArrow(learn, "bias double, w binary, v binary").collect()
    if not model:
        return 0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    bias, w, v = model[0]
    return bias, np.frombuffer(w, np.float32), np.frombuffer(v, np.float32).reshape(-1, FACTORS)


def _scorer(model: tuple[float, np.ndarray, np.ndarray]):
    bias, w, v = model
    squares = (v * v).sum(axis=1)

    def of(texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at = term_places(text)
            total = v.take(at, axis=0).sum(axis=0, dtype=np.float64)
            y = bias + w[at].sum(dtype=np.float64) + (total @ total - squares[at].sum(dtype=np.float64)) / (2 * max(1, np.count_nonzero(squares[at])))
            out[i] = 1 / (1 + np.exp(-np.clip(y, -500, 500)))
        return out

    return of


def score(documents: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, key and check (two hashes of the text), score, predicted."""
    known = documents.sparkSession.sparkContext.broadcast(model)  # 10 MB, whatever the input

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(known.value)
        for batch in sliced(batches, keep="terms"):
            s = of(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "key", "check", "score", "predicted"])

    return text_rows(documents, id_col, text_col).select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(each, "doc_id long, key long, check long, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, max_train_rows: int = 16_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored too (by the bias); a null doc_id is kept and not held out; repeated rows are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    scored = score(documents, fit(documents, labels, max_train_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def remove_toxic(documents: DataFrame, labels: DataFrame, max_train_rows: int = 16_000, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays under the threshold; all columns stay, and without labels all documents.

    Rows are scored where they are and let through or not, so nothing moves."""
    model = fit(documents, labels, max_train_rows)
    if model[0] == 0.0 and not model[1].any():  # nothing was learned
        return documents
    known, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")
    small_batches(documents.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(known.value)
        for batch in sliced(batches, keep="terms"):
            yield batch.filter(pa.array(of([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    return documents.mapInArrow(each, documents.schema)
