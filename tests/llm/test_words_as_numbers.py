import pytest

from lathwork.llm import collocations
from test_audit_urls_phrases import brute_collocations, phrase_rows


@pytest.mark.parametrize(("sample", "bits"), [(0.0, 17), (1.0, 17), (1.0, 3)])
def test_any_choice_of_numbered_words_gives_the_same_phrases(spark, monkeypatch, sample, bits):
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    monkeypatch.setattr(collocations, "ID_BITS", bits)
    docs = phrase_rows()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    known = collocations.numbered_words(df)
    ids = [r.id for r in known.collect()]
    assert len(ids) == len(set(ids)) and all(0 < i < 1 << bits for i in ids) and bool(ids) == bool(sample)
    rows = collocations.ngram_rows(df, known, 3)
    spelled = rows.where("key is not null").count()
    assert rows.where("code is not null and key is not null").isEmpty()
    assert spelled == rows.count() if not sample else spelled == 0 if bits == 17 else 0 < spelled < rows.count()  # all were spelled out before
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, 3, 5, 2000, 50).collect())
    assert got == brute_collocations(docs, 3, 5, 2000, 50)
