from collections import Counter, defaultdict

import corpus_pipeline
from lathwork.llm import decontamination, pii, toxicity
from lathwork.llm.shared import stored
from test_text_operators import brute_components, slow_base


def test_stages_like_brute_force(spark, sf_dir, documents):
    extra = [(None, "no id here at all in this row", "en", "s", 29), (70_001, None, "en", None, 0), (70_002, "", None, "s", 0), (70_003, "twice the same row of words", "en", "s", 27), (70_003, "twice the same row of words", "en", "s", 27)]
    docs = stored(documents.unionByName(spark.createDataFrame(extra, documents.schema)), "in")
    columns = documents.columns
    rows = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    stages = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one = stored(stages["toxicity"](spark, docs, sf_dir), "one")
    scores = {r.key: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    by_text = {r.text: r.k for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) as k").collect()}
    assert rows(one) == Counter({r: n for r, n in rows(docs).items() if scores[by_text[r[1]]] < 0.5})

    two = stored(stages["ngram_jaccard_join"](spark, one, sf_dir), "two")
    before = [(r.doc_id, r.text) for r in one.collect()]
    least = {(d, n): c for (d, n, c) in brute_components(before, 5, 80)}
    kept = {d for d, _ in before if any(c == d for (x, _), c in least.items() if x == d)}
    assert {r.doc_id for r in two.collect()} == kept and two.where("doc_id = 70003").count() == 1

    three = stored(stages["decontamination"](spark, two, sf_dir), "three")
    items = [decontamination.word_hashes(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda t: any(len(i) and sum(n for _, _, n in decontamination.tiles(i, decontamination.word_hashes(t or ""), 5)) >= 0.5 * len(i) for i in items)
    assert rows(three) == Counter({r: n for r, n in rows(two).items() if not leaks(r[1])})

    four = stored(stages["personal_data"](spark, three, sf_dir), "four")
    spans = {r.key: r.spans for r in pii.personal_data(three).collect()}
    want = Counter()
    for (doc_id, text, lang, source, _), n in rows(three).items():
        said = spans[by_text[text]]
        assert set(f"{k}:{a}:{b}" for k, a, b in slow_base(text or "")) <= set(said.split(","))
        masked = None if text is None else pii.masked(text, said)
        want[(doc_id, masked, lang, source, None if text is None else len(masked))] += n
    assert rows(four) == want

    bins = defaultdict(int)
    for r in stages["best_fit_packing"](spark, four, sf_dir).collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_near_copies_under_one_id(spark, sf_dir):
    """Of a group one row stays, also where different texts share the id it is named by."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-2], "y", "z"])]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (6, texts[2]), (9, "something else altogether with many words"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, stored(docs, "in"), sf_dir).collect()
    assert sorted(str(r.doc_id) for r in out) == ["5", "9", "None"]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_nothing_and_on_clashing_names(spark, sf_dir, odd_documents, no_documents):
    """Each stage on an empty table, and on awkward rows with columns named like those used inside."""
    clash = odd_documents.selectExpr("*", "1 as _id", "2 as _key", "3 as _bad_key", "'x' as _pii_key", "'y' as _pii_spans", "4 as component_id", "5 as row", "6 as `check`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_documents, sf_dir).count() == 0, name
        out = stored(stage(spark, stored(clash, "in"), sf_dir), "out")
        assert out.columns == clash.columns, name
        kept, had = (Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "score").collect()) for df in (out, clash))
        assert kept == had or name == "ngram_jaccard_join" and sum(kept.values()) == sum(had.values()) - 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, stored(clash, "in"), sf_dir).select("doc_id", "piece").where("piece = 0").count() == clash.count()
