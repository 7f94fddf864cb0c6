"""Token ids of whole texts by a public byte-level BPE file and the tokenizers library, with a memo of pieces.

A byte-level BPE file cuts a text before its merges.  A single space between two characters that are not white
space always starts a new piece, so does ASCII punctuation after a letter (but for the apostrophe), and a single line
feed is a piece.  So a text may be cut there, each piece encoded once by the library and kept in a bounded memo.
Texts in which a space touches other white space, and those that hold a string of a special token, go to the library
whole and get what its defaults give.  tests/llm holds the result against the library's own on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .shared import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

YOUNG_ENTRIES = 150_000
SLICE_CHARS = 1_000_000
_ODD_SPACE = re.compile(r"[^\S \n]")
_TOUCHING = re.compile(r" \s|\s ")
_DOUBLE = re.compile(r"\s\s")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_AFTER_LETTER = re.compile(rf"[!-&(-/:-@\[-`{{-~](?<=[{_LATIN}].)")
_LATIN_WORD = re.compile(f" ?[{_LATIN}]+").fullmatch


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_level() -> dict[int, str]:
    """How the space and Latin letters are spelled inside a byte-level vocabulary, as the library says."""
    from tokenizers import pre_tokenizers

    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {c: spell(chr(c))[0][0] for c in (32, *range(0xC0, 0x100))}


class Memo:
    """Pieces to their bytes, in two generations: what was not asked for since the last change of them is let go."""

    def __init__(self) -> None:
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def find(self, pieces: list[str]) -> tuple[list, list[int]]:
        """What is known of each piece, and the places of those that are not."""
        got = list(map(self.young.get, pieces))
        if None not in got:
            return got, []
        unknown, old = [], self.old
        for i in [i for i, x in enumerate(got) if x is None]:
            if (x := old.get(pieces[i])) is None:
                unknown.append(i)
            else:
                got[i] = self.young[pieces[i]] = x
        return got, unknown

    def tidy(self) -> None:
        if len(self.young) > YOUNG_ENTRIES:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids as little-endian uint16 (the vocabulary has under 65,536 entries), and how many characters each adds."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 entries")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.said = _byte_level()
        self.ids, self.spans = Memo(), Memo()

    def pieces(self, text: str) -> list[str]:
        """The text cut where the vocabulary always cuts; a list of one piece is the whole text."""
        if not text:
            return []
        if "\x01" in text or "  " in text or " \n" in text or "\n " in text or any(s in text for s in self.special):
            return [text]
        double = "\n\n" in text
        if _ODD_SPACE.search(text):
            if _TOUCHING.search(text):
                return [text]
            double = double or _DOUBLE.search(text)
        if not double:
            text = text.replace("\n", "\x01\n\x01")
        text = _AFTER_LETTER.sub("\x01\\g<0>", text)
        return text.replace(" ", "\x01 ").split("\x01")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are new.  Latin words, one piece for the vocabulary too, go to the library's BPE model at once."""
        out: dict[str, bytes] = {"": b""}
        rest, merge, said = [], self.tokenizer.model.tokenize, self.said
        for x in new:
            if _LATIN_WORD(x):
                out[x] = array("H", [t.id for t in merge(x.translate(said))]).tobytes()
            elif x:
                rest.append(x)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[x] = array("H", e.ids).tobytes()
        return out

    def _learn_spans(self, new: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and each token's first and one-past-last character."""
        out = {"": (b"", b"")}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for x, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                out[x] = np.array(e.ids, "<u2").tobytes(), np.array(e.offsets, "<u4").reshape(-1, 2).tobytes()
        return out

    def _found(self, texts: Iterable[str], memo: Memo, learn) -> Iterator[tuple[list[str], list]]:
        """Pieces of each text and what is kept of each; single whole texts are not kept."""
        for lists in self._slices(texts):
            found = [memo.find(p) for p in lists]
            new = list({p[i] for p, (_, unknown) in zip(lists, found, strict=True) for i in unknown})
            learnt = learn(new)
            for p, (got, unknown) in zip(lists, found, strict=True):
                for i in unknown:
                    got[i] = learnt[p[i]]
                if len(p) > 1:
                    memo.young.update((p[i], got[i]) for i in unknown)
                yield p, got
            memo.tidy()

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for _, got in self._found(texts, self.ids, self._learn):
            yield np.frombuffer(b"".join(got), "<u2")

    def encode_with_spans(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and each token's first and one-past-last character in the whole text (code points)."""
        for p, got in self._found(texts, self.spans, self._learn_spans):
            spans = [x for _, x in got]
            s = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
            chars = np.fromiter(map(len, p), np.int64, len(p))
            tokens = np.fromiter(map(len, spans), np.int64, len(p)) >> 3
            s += np.repeat(np.cumsum(chars) - chars, tokens)[:, None]
            yield np.frombuffer(b"".join([x for x, _ in got]), "<u2"), s[:, 0], s[:, 1]

    def _slices(self, texts: Iterable[str]) -> Iterator[list[list[str]]]:
        held, size = [], 0
        for text in texts:
            held.append(self.pieces(text))
            size += len(text)
            if size > SLICE_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One in each Python worker, reused from task to task."""
    return Encoder(path)


KEPT["tokens"] = encoder.cache_clear
