"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base kinds are email, ip, card and phone (regular expressions, checks, no retries).  Every base match is a seed entity.
The words beside known entities (the last one and the last two in front, the first one behind) are lexical patterns.
Loosely shaped strings (an address spelled with "(at)", a number without its plus sign or with a wrong check digit)
are candidates.  Spark scores the bipartite graph of patterns and instances in rounds: a pattern is as good as the
share of known entities of its kind among all seeds and candidates of any kind that stand there, taken at the lower
end of its 95 % interval, so that few or mixed cases count for little; an instance is as good as its good patterns
together.  Instances that are good enough are known from then on, wherever they stand, and induce patterns of their
own in the next round; rounds end when none is new.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sliced, small_batches, small_enough, stored, text_keys, text_rows

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its start only: a match that fails there fails further on too
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# what the method may add, by kind, where the context says so
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9+])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
}
_WORD = re.compile(r"[^\W\d_]+")
_BESIDE = 80  # characters looked at on either side of an entity for its context words


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive; leftmost, not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates for the method: loosely shaped, and apart from all base spans."""
    if not _DIGITS.search(text) and "at" not in text:
        return []
    taken = {x for _, a, b in base for x in range(a, b)}
    found = []
    for kind in KINDS:
        for m in _LOOSE[kind].finditer(text) if kind != "email" or "at)" in text or "at]" in text else ():
            if taken.isdisjoint(range(m.start(), m.end())):
                found.append((kind, m.start(), m.end()))
                taken.update(range(m.start(), m.end()))
    return found


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns beside a place, lower-cased: the last word in front, the last two, and the first word behind."""
    words = _WORD.findall(text[max(0, start - _BESIDE) : start].lower())
    if start > _BESIDE and words and text[start - _BESIDE - 1].isalpha():
        words = words[1:]  # it may have been cut
    behind = _WORD.search(text[end : end + _BESIDE].lower())
    return ["<" + " ".join(words[-n:]) for n in (1, 2) if len(words) >= n] + ([">" + behind[0]] if behind else [])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = "struct<kind:string,start:int,end:int,instance:long,patterns:array<string>>"
SCHEMA = f"doc_id long, key long, check long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, seeds array<{_SPAN}>, loose array<{_SPAN}>"


def extract(docs: DataFrame) -> DataFrame:
    """One pass: per document its base spans, their digest, and seeds and candidates with their contexts."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
    kinds = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), *((k, pa.int64()) for k in kinds), ("base", pa.string()), ("base_sha256", pa.string()), ("seeds", pa.list_(span)), ("loose", pa.list_(span))])

    def rows(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
        name = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return [{"kind": k, "start": a, "end": b, "instance": name(text[a:b]), "patterns": contexts(text, a, b)} for k, a, b in spans]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for doc_id, key, check, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_spans(text)
                n = {f"n_{k}": sum(1 for s in base if s[0] == k) for k in KINDS}
                said = joined(base)
                out.append({"doc_id": doc_id, "key": key, "check": check, **n, "base": said, "base_sha256": hashlib.sha256(said.encode()).hexdigest(), "seeds": rows(text, base), "loose": rows(text, loose_spans(text, base))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(each, SCHEMA)


def lower_share(k: Column, n: Column, z: float = 1.96) -> Column:
    """The lower end of the Wilson interval of the share k / n."""
    p = F.least(k / n, F.lit(1.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def bootstrap(found: DataFrame, least_known: int = 3, confidence: float = 0.5) -> DataFrame:
    """Candidates that become known, (kind, instance, score), from the stored result of :func:`extract`."""
    place = lambda c, seed: found.select(F.explode(c).alias("s")).select("s.kind", "s.instance", F.explode("s.patterns").alias("pattern"), F.lit(seed).alias("seed"))
    edges = place("seeds", True).unionByName(place("loose", False)).groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = stored(edges, "edges")
    # patterns with no candidate, and those that so few instances meet that they could never be one, find nothing
    slots = edges.groupBy("pattern").agg(F.sum("n").alias("slots"), F.count("*").alias("k"), F.min("seed").alias("all_seeds")).where(f"not all_seeds and k > {least_known}").select("pattern", "slots")
    edges = stored(edges.join(_few(stored(slots, "slots")), "pattern"), "graph")
    known = stored(edges.where("seed").select("kind", "instance", F.lit(1.0).alias("score")).distinct(), "known")
    while True:
        met = edges.join(_few(known), ["kind", "instance"])
        patterns = met.groupBy("kind", "pattern").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("score")).alias("m"), F.max("slots").alias("slots"))
        patterns = patterns.select("kind", "pattern", "k", lower_share(F.col("m"), F.col("slots")).alias("good")).where((F.col("k") >= least_known) & (F.col("good") >= confidence))
        patterns = stored(patterns.select("kind", "pattern", "good"), "patterns")
        open_edges = edges.where("not seed").join(_few(known), ["kind", "instance"], "left_anti")
        fresh = open_edges.join(_few(patterns), ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("good"))))).alias("score"))
        fresh = stored(fresh.where(F.col("score") >= confidence), "fresh")
        if fresh.isEmpty():
            return known.where("score < 1")
        known = stored(known.unionByName(fresh), "known")


def personal_data(documents: DataFrame, least_known: int = 3, confidence: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, key, check, n_<kind> (base), base_sha256, spans (base and added), n_added.

    Null and empty texts have no spans; very long ones are read whole; repeated rows give repeated results; a null
    doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    docs = text_rows(documents, id_col, text_col)
    found = stored(extract(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    good = stored(bootstrap(found, least_known, confidence), "accepted")
    loose = found.select("row", F.explode("loose").alias("s")).select("row", "s.kind", "s.start", "s.end", "s.instance")
    added = loose.join(_few(good), ["kind", "instance"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return found.join(added, "row", "left").select("doc_id", "key", "check", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _all_spans().alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def _all_spans() -> Column:
    """Base and added spans by kind as listed, then start, comma-joined."""
    order = "array('" + "','".join(KINDS) + "')"
    every = F.expr(f"concat(transform(seeds, s -> struct(array_position({order}, s.kind) as k, s.start as a, s.end as b, s.kind as kind)), coalesce(transform(added, s -> struct(array_position({order}, s.kind) as k, s.start as a, s.end as b, s.kind as kind)), array()))")
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def masked(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    cuts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, k in cuts:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, **options) -> DataFrame:
    """The documents with personal data masked; n_chars, where present, follows; all other columns stay.

    Base spans are found again where the text is; only the few documents with added spans bring theirs by a join.
    """
    names = documents.columns
    key_name, check_name, spans_name = ("pii_" + x + "_" * (1 + max(map(len, names))) for x in ("key", "check", "spans"))  # longer than any name there is
    more = personal_data(documents, **options).where("n_added > 0").select(F.col("key").alias(key_name), F.col("check").alias(check_name), F.col("spans").alias(spans_name)).distinct()
    more = _few(stored(more, "added"), 100_000)
    key, check = text_keys(F.coalesce(documents["text"], F.lit("")))
    marked = documents.join(more, (key == more[key_name]) & (check == more[check_name]), "left").drop(key_name, check_name)
    at_text, at_spans = names.index("text"), len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t if t is None else masked(t, s if s is not None else joined(base_spans(t))) for t, s in zip(batch.column(at_text).to_pylist(), batch.column(at_spans).to_pylist(), strict=True)]
            cols = [c for i, c in enumerate(batch.columns) if i != at_spans]
            cols[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    small_batches(documents.sparkSession)
    out = marked.mapInArrow(each, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
