import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathwork.llm import components, decontamination, id_codec, jaccard_join, packing, pii, token_counts, tokens, toxicity


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


AWKWARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb", "Don't stop. 12,5 %", "\ta b c d", "x  y", "<|endoftext|> z", "é́ ñ 東京 🙂🙂 ok", "a\x1c b", "!!! ??? a.b,c;d", "\x01 a \x01"]


def test_ids_are_the_librarys_own(documents):
    texts = AWKWARD + [r.text or "" for r in documents.limit(60).collect()]
    want = plain_tokenizer().encode_batch(texts, add_special_tokens=False)
    e = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):  # with the memo cold and warm
        assert [list(x) for x in e.encode(texts)] == [w.ids for w in want]
    e = tokens.Encoder(tokens.default_vocabulary())
    for text, (ids, first, last), w in zip(texts, e.encode_with_spans(texts), want, strict=True):
        assert list(ids) == w.ids, text
        assert list(zip(first.tolist(), last.tolist(), strict=True)) == w.offsets, text


def brute_components(rows, words, percent):
    sets, parent = {}, {}
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in out.items()}
    return Counter((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(n, seed=5):
    """A base text, copies with one to four words changed, chains of them, and texts that share a common line."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=90)
    common = rng.choices(vocabulary, k=15)
    rows, last = [(1000, " ".join(base))], base
    for i in range(n):
        words = list(last if i % 7 == 0 else base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        last = words
        rows.append((1001 + i, " ".join(words)))
        rows.append((5000 + i, " ".join(common + rng.choices(vocabulary, k=40))))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_like_all_pairs(spark, odd_documents, words, percent):
    rows = near_copies(70) + [(r.doc_id, r.text) for r in odd_documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_components(df, words, percent)
    assert got.columns == ["doc_id", "key", "n_shingles", "component_id", "class_id", "n_links"]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, words, percent)


def test_exact_links_like_all_pairs(spark):
    word = [f"w{i}" for i in range(60)]
    copies = [(i, " ".join(word[:i] + ["new"] + word[i:])) for i in range(0, 60, 3)] + [(90 + i, " ".join(word[i:])) for i in range(4)] + [(99, " ".join(word))]
    rows = copies + near_copies(30) + [(500, None), (501, "one")]
    sets = {i: frozenset(jaccard_join.shingle_hashes(t or "", 3).tolist()) for i, t in enumerate(t for _, t in rows)}
    classes = set(sets.values()) - {frozenset()}
    links = {s: sum(1 for q in classes if q != s and 100 * len(s & q) >= 90 * len(s | q)) for s in classes}
    want = Counter((rows[i][0], links.get(s, 0)) for i, s in sets.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.n_links) for r in jaccard_join.jaccard_components(df, exact_links=True).collect()) == want
    short = sum(r.n_links for r in jaccard_join.jaccard_components(df).collect())
    assert short < sum(n * k for (_, n), k in want.items()), short


def test_jaccard_components_of_nothing(no_documents):
    assert jaccard_join.jaccard_components(no_documents).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_coded_ids_take_fewer_bits_than_zlib(documents):
    """A model cut down to a few places would not: real blocks, each alone."""
    got = tokens.encoder(tokens.default_vocabulary()).encode([r.text or "" for r in documents.collect()])
    ids = np.concatenate([np.asarray(g, "<u2") for g in got])
    blocks = [ids[i : i + id_codec.BLOCK_IDS] for i in range(0, len(ids), id_codec.BLOCK_IDS)]
    ours, plain = sum(map(len, id_codec.encode_blocks(blocks))), sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)
    assert ours < 0.93 * plain


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint16), np.array([65535], np.uint16), rng.integers(0, 65536, 700).astype(np.uint16), np.tile(np.array([5, 9, 50256], np.uint16), 500), np.full(900, 7, np.uint16)]
    coded = id_codec.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(id_codec.decode_blocks(coded), blocks, strict=True))
    assert len(coded[3]) < 500 and len(coded[4]) < 200
    for at in (2, 9, 30):
        bad = bytearray(coded[2])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            id_codec.decode_blocks([bytes(bad)])


def test_ids_in_files(spark, odd_documents, no_documents, documents):
    t = plain_tokenizer()
    df = odd_documents.select("doc_id", "text").union(documents.select("doc_id", "text").limit(40).withColumn("doc_id", F.col("doc_id") + 100))
    got = id_codec.coded_ids(df).collect()
    want = Counter()
    for r in df.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert id_codec.coded_ids(no_documents).count() == 0
    files = id_codec.write_ids(df)
    with pytest.raises(Exception, match="list of documents is damaged"):
        id_codec.read_ids(files.withColumn("lengths", F.reverse("lengths"))).count()


def test_packing(spark, odd_documents, no_documents, documents):
    df = odd_documents.select("doc_id", "text").union(documents.select("doc_id", "text"))
    rows = packing.pack(df, capacity=512).collect()
    t = plain_tokenizer()
    want = Counter()
    for r in df.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        for k in range(len(cuts) - 1):
            want[(r.doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(np.array(ids[cuts[k] : cuts[k + 1]], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in rows) // 512) + 1
    assert packing.pack(no_documents).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 5, 5, 3, 3, 2, 2]
    poor = [[0, 2], [1], [3, 4], [5], [6, 7], [8, 9]]
    better = packing.improve(poor, lengths, 10)
    assert sorted(i for b in better for i in b) == list(range(10))
    assert all(sum(lengths[i] for i in b) <= 10 for b in better)
    assert len(better) == 4  # 40 tokens in bins of 10
    square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert square(better) > square(poor)


def test_local_search_goes_on_until_no_exchange_is_left():
    """Near-equal lengths, where best fit leaves room in every bin; and bins of more than 64 pieces."""
    state, lengths = 1, []
    for _ in range(300):
        state = state * 48271 % 2147483647
        lengths.append(600 + state % 161)
    bins = packing.best_fit(lengths, 2048)
    better = packing.improve(bins, lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(300))
    fill = [sum(lengths[i] for i in b) for b in better]
    assert max(fill) <= 2048 and len(better) <= 0.95 * len(bins)
    some = lambda b, n: [sum(x) for x in itertools.combinations([lengths[i] for i in b], n)]
    for s, t in itertools.permutations(range(len(better)), 2):
        a, b = better[s], better[t]
        steps = [(g, x) for g in some(a, 1) for k in (0, 1, 2) for x in some(b, k)] + [(g, x) for g in some(a, 2) for k in (0, 1) for x in some(b, k)]
        assert not any(0 < g - x <= 2048 - fill[t] and fill[t] + g - x > fill[s] for g, x in steps)
    many = [6, *[1] * 67, 2, 3]  # 6 can go only where 2 and 3 come back
    assert sorted(sorted(many[i] for i in b) for b in packing.improve([[0], [*range(1, 70)]], many, 73)) == [[1] * 67 + [6], [2, 3]]


def test_section_tokens(spark, odd_documents, no_documents, documents):
    df = odd_documents.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(documents.select("doc_id", "text").limit(30).withColumn("doc_id", F.col("doc_id") + 100))
    got = defaultdict(dict)
    for r in token_counts.section_tokens(df).collect():
        got[r.doc_id][r.section] = (r.start, r.end, r.n_tokens, r.n_crossing, r.doc_tokens)
    t = plain_tokenizer()
    for r in df.collect():
        text, enc = r.text or "", t.encode(r.text or "", add_special_tokens=False)
        lines = text.splitlines(keepends=True) if "\n" in text and not re.search("[\r\x0b\x0c\x1c-\x1e\x85  ]", text) else re.findall("[^\n]*\n|[^\n]+", text) or [""]
        spans, at = [], 0
        for line in lines:
            spans.append((at, at + len(line)))
            at += len(line)
        count, cross = Counter(), Counter()
        for a, b in enc.offsets:
            shares = [(-max(0, min(b, e) - max(a, s)), i) for i, (s, e) in enumerate(spans)]
            k = min(shares)[1]
            count[k] += 1
            cross[k] += sum(1 for s, _ in shares if s < 0) > 1
        assert got[r.doc_id] == {i: (s, e, count[i], cross[i], len(enc.ids)) for i, (s, e) in enumerate(spans)}
    assert token_counts.section_tokens(no_documents).count() == 0
    a, b, ends = np.array([0, 3, 5]), np.array([3, 5, 12]), np.array([4, 6, 12])
    assert token_counts.attribute(a, b, ends, "start")[0].tolist() == [0, 0, 1]
    assert token_counts.attribute(a, b, ends, "largest")[0].tolist() == [0, 0, 2]


def slow_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PII = ["a@b.co, x.y@c-d.e.f and @q.r a@@b.c z@b. q@b..c", "1.2.3.4.5 256.1.1.1 001.02.3.4 9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123", "+1 (988) 555-2485 +49 30 1234567. +1+2 +12 345 +1234567890123456", "é😀 a@b.co 😀", "9" * 5000, "a" * 3000 + "@b.c"]


def test_base_spans_like_the_patterns(documents):
    for text in PII + [r.text or "" for r in documents.collect()]:
        assert pii.base_spans(text) == slow_base(text), text[:80]


def test_base_spans_random():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choices("0123456789..@+- ()ab", k=rng.randint(1, 60)))
        assert pii.base_spans(text) == slow_base(text), text


def test_personal_data_and_bootstrap(spark, odd_documents, no_documents):
    rows = [(i, f"some words then please mail contact{i}@mail.example.com today") for i in range(8)]
    rows += [(50, "some words then please mail hidden (at) example.com now"), (51, "nothing like a context unseen (at) example.org here"), (53, "elsewhere hidden (at) example.com"), (52, "please call 12")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_email == 1 and got[0].n_added == 0
    text = rows[8][1]
    at = text.index("hidden")
    assert got[50].n_email == 0 and got[50].n_added == 1 and got[50].spans == f"email:{at}:{at + len('hidden (at) example.com')}"
    assert got[51].n_added == 0 and got[51].spans == ""
    assert got[53].spans == "email:10:33"  # what is known by one context is known anywhere
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(rows[0][1]))
    assert got[0].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[0].spans == said
    assert pii.personal_data(odd_documents).count() == odd_documents.count()
    assert pii.personal_data(no_documents).count() == 0


def slow_bootstrap(texts, least=3, confidence=0.5):
    """Added spans of each text, by dictionaries and loops."""
    places = []  # text, kind, span, instance, patterns, seed
    for t, text in enumerate(texts):
        base = slow_base(text)
        for seed, spans in ((True, base), (False, pii.loose_spans(text, base))):
            for kind, a, b in spans:
                left = [w.lower() for w in re.findall(r"[^\W\d_]+", text[:a])]
                right = [w.lower() for w in re.findall(r"[^\W\d_]+", text[b:])]
                patterns = [("L", *left[-n:]) for n in (1, 2) if len(left) >= n] + [("R", w) for w in right[:1]]
                places.append((t, kind, (a, b), text[a:b], patterns, seed))
    slots = Counter(p for x in places for p in x[4])
    known = {(x[1], x[3]): 1.0 for x in places if x[5]}
    while True:
        mass, who = Counter(), defaultdict(set)
        for _, kind, _, instance, patterns, _ in places:
            for p in patterns:
                if (kind, instance) in known:
                    mass[kind, p] += known[kind, instance]
                    who[kind, p].add(instance)
        good = {}
        for (kind, p), m in mass.items():
            n, z = slots[p], 1.96
            share = min(1.0, m / n)
            low = (share + z * z / (2 * n) - z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if len(who[kind, p]) >= least and low >= confidence:
                good[kind, p] = low
        fresh = {}
        for _, kind, _, instance, _, _ in places:
            if (kind, instance) not in known:
                miss = 1.0
                for p in {p for x in places if (x[1], x[3]) == (kind, instance) for p in x[4]}:
                    miss *= 1 - good.get((kind, p), 0.0)
                if 1 - miss >= confidence:
                    fresh[kind, instance] = 1 - miss
        if not fresh:
            break
        known |= fresh
    return [sorted((x[1], *x[2]) for x in places if x[0] == t and not x[5] and (x[1], x[3]) in known) for t in range(len(texts))]


def test_bootstrap_rounds_like_loops(spark):
    """Contexts found by seeds, contexts found by what those found, and contexts that stand before anything."""
    rng = random.Random(8)
    texts = [f"so mail user{i}@corp.org now" for i in range(9)] + [f"so mail via{i} (at) corp.org then" for i in range(2)]
    texts += [f"please ping via{i} (at) corp.org soon" for i in range(2)] + [f"please ping other{i}@corp.org soon" for i in range(7)] + ["please ping new (at) corp.org soon", "ring new (at) corp.org", "ring lone (at) corp.org"]
    texts += [f"the {'4111 1111 1111 1111' if i % 2 else '4111 1111 1111 11%02d' % (i + 20)} and" for i in range(30)]
    for _ in range(150):
        name = f"{rng.choice('abc')}{rng.randrange(25)}"
        texts.append(f"{rng.choice(['call', 'write', 'see', 'from'])} {rng.choice(['me', 'us'])} {name}{rng.choice(['@x.org', '@x.org', '@x.org', ' (at) x.org', '(at)x.org'])} {rng.choice(['today', 'or', 'and'])}")
    want = slow_bootstrap(texts)
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        base = Counter(f"{k}:{a}:{b}" for k, a, b in slow_base(text))
        assert Counter(s for s in got[i].spans.split(",") if s) - base == Counter(f"{k}:{a}:{b}" for k, a, b in want[i]), text
    added = {texts[i] for i in range(len(texts)) if want[i]}
    assert "please ping new (at) corp.org soon" in added and "ring new (at) corp.org" in added and "ring lone (at) corp.org" not in added
    assert not any(t.startswith("the 4") for t in added)


def test_redaction(spark):
    rows = [(1, "mail a@b.co or +1 (988) 555-2485.", "en", "s", 0), (2, None, "en", None, 0), (None, "clean", None, "s", 5)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("mail <email> or <phone>.", 24), 2: (None, None), None: ("clean", 5)}
    assert pii.masked("0123456789", "a:2:5,b:4:7,c:7:8") == "01<a><c>89"


def test_tiles():
    h = lambda s: decontamination.word_hashes(s)
    item = "a b c d e f g h i j"
    assert decontamination.tiles(h(item), h("x a b c d e f y g h i j z"), 3) == [(0, 1, 6), (6, 8, 4)]
    assert sum(n for _, _, n in decontamination.tiles(h(item), h("f g h i j zz a b c d e"), 4)) == 10  # reordered halves
    assert decontamination.tiles(h(item), h("a b x c d y e f"), 3) == []
    assert decontamination.tiles(h("a a a a a a"), h("a a a a a a a a"), 3)[0] == (0, 0, 6)
    assert decontamination.tiles(h(""), h("a b c"), 3) == []


def slow_tiles(item, doc, least):
    """Longest matches of unmarked words by comparing every two places, again and again."""
    item, doc, found = list(item), list(doc), []
    used, taken = set(), set()
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used and j + n not in taken:
                    n += 1
                best.append((-n, i, j))
        n, i, j = min(best, default=(0, 0, 0))
        if -n < max(1, least):
            return found
        found.append((i, j, -n))
        used.update(range(i, i - n))
        taken.update(range(j, j - n))


def test_tiles_like_comparing_all_places():
    rng = random.Random(12)
    for _ in range(400):
        words = "ab" if rng.random() < 0.4 else "abcdefgh"
        item, doc = (rng.choices(words, k=rng.randint(0, 16)) for _ in range(2))
        least = rng.randint(1, 4)
        h = [decontamination.word_hashes(" ".join(x)) for x in (item, doc)]
        assert decontamination.tiles(*h, least) == slow_tiles(item, doc, least), (item, doc, least)


def test_tiles_of_many_equal_words():
    same = decontamination.word_hashes("y " * 20_000)
    assert decontamination.tiles(same, same, 5) == [(0, 0, 20_000)]
    assert decontamination.tiles(same[:300], same, 5) == [(0, 0, 300)]
    pieces = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(1500)]
    mixed = decontamination.word_hashes(" x ".join(reversed(pieces)))
    assert sum(n for _, _, n in decontamination.tiles(decontamination.word_hashes(" ".join(pieces)), mixed, 5)) == 7500


def test_decontamination(spark, sf_dir, documents, odd_documents, no_documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    words = items[0][1].split()
    half = len(words) // 2
    extra = [(9001, "lead in " + " ".join(words[half:]) + " filler between " + " ".join(words[:half]) + " end", None), (9002, " ".join(words[: len(words) // 4]), None)]
    df = documents.select("doc_id", "text", F.lit(1).alias("item_id")).union(spark.createDataFrame(extra, "doc_id long, text string, item_id int"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    want = set()
    for r in df.collect():
        doc = decontamination.word_hashes(r.text or "")
        for i, text in items:
            item = decontamination.word_hashes(text)
            if len(item) and sum(n for _, _, n in decontamination.tiles(item, doc, 5)) >= 0.5 * len(item):
                want.add((r.doc_id, i))
    assert got == want and (9001, items[0][0]) in got and not any(d == 9002 for d, _ in got)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, broadcast_seeds=0).collect()} == got
    assert decontamination.contaminated(odd_documents, bench).count() == 0
    assert decontamination.contaminated(no_documents, bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    left = decontamination.remove_contaminated(df, bench)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in df.collect()} - {d for d, _ in want}


def test_short_items_and_items_without_an_id(spark):
    bench = spark.createDataFrame([(1, "Quite short item"), (None, "an item of six words here"), (3, ""), (4, None), (5, "an item of six words here")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so a quite short item it is"), (2, "quite short, no item"), (3, "see an item of six words here too"), (4, None)], "doc_id long, text string")
    for most in (1000, 0):
        got = {(r.doc_id, r.item_id, r.coverage) for r in decontamination.contaminated(df, bench, broadcast_seeds=most).collect()}
        assert got == {(1, 1, 1.0), (3, None, 1.0), (3, 5, 1.0)}
        assert {r.doc_id for r in decontamination.remove_contaminated(df, bench, broadcast_seeds=most).collect()} == {2, 4}


def test_toxicity_on_held_out_rows(spark, odd_documents, no_documents):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    found = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    assert right > 0.98 and found > 0.85, (right, found)
    odd = toxicity.toxicity(odd_documents, labels).collect()
    assert len(odd) == odd_documents.count() and all(r.score is not None for r in odd)
    assert toxicity.toxicity(no_documents, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd_documents, labels.limit(0)).collect()} == {0.5}


def test_factorization_learns_pairs():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        words = ["slur"] * int(a) + ["group"] * int(b) + [f"n{i}" for i in rng.integers(0, 30, 4)]
        rows.append(toxicity.term_places(" ".join(words)))
        labels.append(float(a and b))
    bias, w, v = toxicity.train(rows, np.array(labels), epochs=20)

    def score(text):
        at = toxicity.term_places(text)
        total, n = v[at].sum(axis=0), max(1, np.count_nonzero((v[at] ** 2).sum(axis=1)))
        return bias + w[at].sum() + (total @ total - (v[at] ** 2).sum()) / (2 * n)

    assert score("slur group") > 0 > max(score("slur"), score("group"))


def double_loop(model, places):
    """A score with every pair of known terms written out."""
    bias, w, v = model
    known = [p for p in places.tolist() if (v[p] ** 2).sum() > 0]
    pairs = sum(float(v[a].astype(float) @ v[b].astype(float)) for i, a in enumerate(known) for b in known[:i])
    return 1 / (1 + np.exp(-(bias + sum(float(w[p]) for p in places.tolist()) + pairs / max(1, len(known)))))


def test_factorization_learns_pairs_of_neutral_terms(spark):
    """Two words that tell nothing alone: the label is that just one of them is there.  Scores are held to a double loop."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join(["left"] * int(a) + ["right"] * int(b) + [f"n{i}" for i in rng.integers(0, 60, 8)]))
        labels.append(float(a != b))
    rows = [toxicity.term_places(t) for t in texts]
    model = toxicity.train(rows[:2000], np.array(labels[:2000]))
    df = spark.createDataFrame(list(enumerate(texts[2000:])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    want = {i: double_loop(model, r) for i, r in enumerate(rows[2000:])}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert sum((got[i] >= 0.5) == (labels[2000 + i] == 1) for i in want) > 0.98 * len(want)


def test_training_takes_one_row_for_each_id(spark):
    df = spark.createDataFrame([(1, f"word{i} again and again", i % 2) for i in range(50)] + [(2, "some other words", 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model[1].any() == False  # noqa: E712  two rows at most, so no term is in three
