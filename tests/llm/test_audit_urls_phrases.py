import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lathwork.llm import collocations, filter_audit, url_rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_interactions(docs, labels):
    """Every order run over every document."""
    texts = {}
    for i, _, t in docs:
        texts.setdefault(t or "", []).append(i)
    fails = []
    for i, part, t in docs:
        w, t = words(t), t or ""
        smaller = i is not None and any(x is not None and x < i for x in texts[t])
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        label = [any(k == i and i is not None and v == 1 for k, v in ((r[0], r[c]) for r in labels)) for c in (1, 2)]
        fails.append((part or "", {f for f in own if own[f]}, *label))
    out = {}
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in rows if f in r[1] and not r[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & {*before, f} for r in rows), len(gone), sum(f in r[1] and bool(r[1] & before) for r in rows),
                    sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    for (part, order, k), v in out.items():
        v.append(sum(w[1] for (p, o, j), w in out.items() if p == part and o[j - 1] == order[k - 1]))
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    some = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "d%", "e"]) + str(rng.randrange(200)) for _ in range(n)) for n in (5, 99, 100, 150, 400)]
    texts = [None, "", "  ", *some, "y " * 30_000, "SHOUT " * 120]
    docs = [(i if i % 11 else None, rng.choice(["en", "de", None]), rng.choice(texts)) for i in range(90)] + [(4, "en", some[0]), (4, "en", some[0]), (-1, "fr", some[0])]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)] + [(2, None, 1), (None, 1, 1)]
    return docs, labels


def test_filter_interactions_like_running_every_order(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(1)).withColumn("n", F.lit(2))
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = filter_audit.filter_interactions(df.repartition(3), lb)
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in longs) for r in got.collect()} == brute_interactions(docs, labels)
    assert filter_audit.edges_of(spark.createDataFrame([("x", 0, 1, 0, 0)], "part string, mask int, docs long, good long, toxic long"), 5).count() == 80


def test_filter_interactions_of_nothing_other_filters_and_no_parts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "A"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(docs.limit(0), labels, part_col=None).count() == 0
    two = lambda w, t: {"L": F.size(w) < 2, "U": t.rlike("[A-Z]")}
    got = filter_audit.filter_interactions(docs, labels, two, None, None)
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()) == [("LU", 1, 1, 2, 0, 1, 3), ("LU", 2, 1, 0, 1, 0, 1), ("UL", 1, 2, 1, 0, 0, 1), ("UL", 2, 1, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        filter_audit.filter_interactions(docs, labels, lambda w, t: {str(i): t == "" for i in range(7)}, None, None)


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://a.example.com/EN/", "http://xexample.com/en/1", "http://example.com/en",
    "https://x.net/es/1", "https://x.net/es", "https://net/fr/", "https://a..net/fr/", "x://y://net/es/", "http://u@h.net:80/es/", "http://a.b.c.d.e.f.g.h.org/p/q/r/s/t", "http://org/p/qx", "http://é.org/p/q",
    "http://org/p/q/r", "http://./p/", "http://org?x", "http://" + "a." * 5_000 + "net/" + "es/" * 5_000, "http://twice.io/a",
]
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "org", "/p/q"), ("allow", "org", "/p/q/r"), ("block", "g.h.org", ""),
    ("allow", "twice.io", "/"), ("block", "TWICE.io", "/"), ("block", None, None), ("block", "org", "p"),
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for verdict, h, p in rules:
        h, p = (h or "").lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), verdict == "block", h + p))
    return host, path, best and best[3], "allow" if not best or not best[2] else "block"


@pytest.mark.parametrize("most", [100, 3])
def test_url_rules_like_trying_every_rule(spark, most):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "https://net/fr/"), (None, "https://net/fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([*RULES, RULES[0]], "verdict string, host string, path string")
    got = url_rules.url_verdicts(df.repartition(3), rules, broadcast_rules=most)
    want = [(i, *brute_verdict(u, RULES)) for i, u in pages]
    assert sorted(map(str, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()))) == sorted(map(str, want))


def test_url_rules_of_nothing_and_short_hashes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SHORT", 1)  # sixteen short hashes: only whole digests tell expressions apart
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(df, rules).collect()}
    assert got == {i: brute_verdict(u, RULES) for i, u in enumerate(URLS)}
    assert url_rules.url_verdicts(df.limit(0), rules).count() == 0
    none = url_rules.url_verdicts(df, rules.limit(0), default="block").collect()
    assert len(none) == len(URLS) and {(r.rule, r.verdict) for r in none} == {(None, "block")}
    plan = url_rules.url_verdicts(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_collocations(docs, max_n, min_count, top, percent):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (x, q), b in often.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def phrase_rows():
    rng = random.Random(8)
    draw = lambda: " ".join(rng.choice(["New York", "new york city", "of the", "the", "a", "É t", "x\ty", "z,z", "Q.\nq", "ü"]) for _ in range(30))
    return [(rng.choice(["en", "de", None]), draw()) for _ in range(60)] + [("en", None), ("en", ""), ("fr", " , "), ("en", "same words " * 4_000), ("en", "dup dup"), ("en", "dup dup")]


@pytest.mark.parametrize(("most", "max_n", "top"), [(200_000, 3, 2000), (2, 3, 7), (200_000, 4, 2000), (2, 5, 40)])
def test_collocations_like_counting_all(spark, most, max_n, top):
    docs = phrase_rows()
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(1)).withColumn("words", F.lit(1))
    got = collocations.collocations(df.repartition(3), max_n, 5, top, 50, broadcast_counts=most)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == brute_collocations(docs, max_n, 5, top, 50)


def test_collocations_of_nothing_and_of_large_counts(spark, monkeypatch):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    r = collocations.collocations(none).collect()[0]
    assert (r.score, r.n) == (10**6 * (big - 1) ** 2 // (big * (big + 1)), 2 * big + 1)


def test_odd_documents(spark, odd_documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    got = collocations.collocations(odd_documents, 3, 2).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_collocations(rows, 3, 2, 2000, 50)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_interactions(odd_documents, labels).where("filter_order = 'ABCDE' and step = 1").first()
    assert (got.part, got.kept, got.removed) == ("en", 1, len(rows) - 1)
