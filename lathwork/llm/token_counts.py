"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole.  Its tokens' character spans are interval-joined to the spans of its sections,
and a token that crosses a boundary goes to one section by a stated rule:

- ``largest``: the section that holds most of its characters, the earlier one of equals;
- ``start``: the section in which it starts.

Sections cover the whole text: by default each line with its line end is one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .shared import sliced, text_rows


def line_ends(text: str) -> np.ndarray:
    """One past each line's last character, its line feed included; an empty text is one empty line."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section, and whether it crosses a boundary.  ends: sorted section ends that cover the text."""
    a = np.searchsorted(ends, first, side="right")
    b = np.searchsorted(ends, np.maximum(last - 1, first), side="right")
    a, b = np.minimum(a, len(ends) - 1), np.minimum(b, len(ends) - 1)
    at, crosses = a.copy(), a != b
    if rule == "largest":
        for i in np.flatnonzero(crosses):
            edges = np.concatenate(([first[i]], ends[a[i] : b[i]], [last[i]]))
            at[i] = a[i] + int(np.argmax(np.diff(edges)))
    elif rule != "start":
        raise ValueError(f"no such rule: {rule}")
    return at, crosses


def section_tokens(documents: DataFrame, vocabulary: str | None = None, rule: str = "largest", sections: Callable[[str], np.ndarray] = line_ends, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (characters), n_tokens, n_crossing, doc_tokens.

    n_tokens sums to doc_tokens over a document; n_crossing counts the tokens given to the section that reach
    beyond it.  A null or empty text is one empty section without tokens.  Repeated rows give repeated results,
    a null doc_id is kept, an empty table gives no rows, other columns are ignored.
    """
    path = vocabulary or tokens.default_vocabulary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode_with_spans
        for batch in sliced(batches, keep="tokens"):
            texts = batch.column(1).to_pylist()
            doc, cols = [], [[] for _ in range(6)]
            for doc_id, text, (ids, first, last) in zip(batch.column(0).to_pylist(), texts, encode(texts), strict=True):
                ends = sections(text)
                at, crosses = attribute(first, last, ends, rule)
                k = len(ends)
                doc += [doc_id] * k
                cols[0].append(np.arange(k))
                cols[1].append(np.concatenate(([0], ends[:-1])))
                cols[2].append(ends)
                cols[3].append(np.bincount(at, minlength=k))
                cols[4].append(np.bincount(at[crosses], minlength=k))
                cols[5].append(np.full(k, len(ids)))
            arrays = [pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in cols]
            arrays[0] = arrays[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *arrays], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return text_rows(documents, id_col, text_col).mapInArrow(each, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
