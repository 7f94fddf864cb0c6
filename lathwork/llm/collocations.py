"""Phrases whose words stand together more often than apart, by language.

All 1- to max_n-grams of the pieces between punctuation marks are exploded into rows and counted by language, single
words from the counts of pairs.  Frequent words are numbers while n-grams are counted, so that most rows are small.  A phrase can be cut into a first part and a rest; both occur at least as often as the
phrase, so counts under ``min_count`` are needed for nothing but the total and only single words keep them.  Phrases
that mostly occur inside a longer one are dropped: if a longer phrase holds enough of a phrase's occurrences, so does
some phrase of one word more, hence an anti-join with one-word extensions finds all of them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_enough, stored

PIECE_END = r"[.,;:!?\x0A-\x0D]"
#: Counts up to this number of rows go to all tasks, at some 60 bytes each; more are joined by a shuffle.
BROADCAST_COUNTS = 200_000
#: Rows of one language are ranked in so many ranges of hashes before the best of each meet.
SALTS = 64
#: Words that stand for numbers have at most so many bits of them; so many numbers make one of 64 bits.
ID_BITS = 17
CODED = 3
#: Share of the texts in which words to be numbered are looked for.
SAMPLE = 0.1


def _pieces(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, w): the words of each piece that has any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    pieces = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, PIECE_END, -1)).alias("piece"))
    return pieces.select("lang", F.array_remove(F.split(F.translate("piece", "\t", " "), " ", -1), "").alias("w")).where(F.size("w") > 0)


def numbered_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, id), stored: words that a sample of the texts holds often, as numbers from 1.

    A word's number is its hash, and of words with one number the most frequent keeps it: there are no more than 2**ID_BITS.
    They only make rows smaller; words without a number are spelled out, and results do not depend on which ones have one.
    """
    words = _pieces(docs.sample(SAMPLE, 7), lang_col, text_col).select("lang", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("f"))
    slot = F.pmod(F.xxhash64("lang", "word"), F.lit((1 << ID_BITS) - 1)) + 1
    best = words.groupBy(slot.alias("id")).agg(F.max(F.struct("f", "lang", "word")).alias("b"))
    return stored(best.select("b.lang", "b.word", "id"), "numbered-words")


def ngram_rows(docs: DataFrame, known: DataFrame, max_n: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(code, key) for each occurrence of each 2- to max_n-gram within a piece; the last word of a piece stands alone.

    Up to three words that all have numbers are one number, ``code``; else ``key`` is phrase, tab and language.
    """
    shifted = [F.slice("w", k, F.size("w")).alias(f"w{k}") for k in range(1, max_n + 1)]
    rows = _pieces(docs, lang_col, text_col).select("lang", F.inline(F.arrays_zip(*shifted)))
    for k in range(1, min(max_n, CODED) + 1):
        rows = rows.join(F.broadcast(known.select("lang", F.col("word").alias(f"w{k}"), F.col("id").alias(f"c{k}"))), ["lang", f"w{k}"], "left")
    code, lang = F.col("c1"), F.concat(F.lit("\t"), F.col("lang"))
    out = []
    for k in range(2, max_n + 1):
        code = code.bitwiseOR(F.shiftleft(f"c{k}", ID_BITS * (k - 1))) if k <= CODED else F.lit(None).cast("long")  # null if one has no number
        parts = [x for i in range(1, k + 1) for x in (F.lit(" "), F.col(f"w{i}"))][1:]
        text = F.concat(*parts, lang)  # null beyond the piece's end
        if k == 2:
            code, text = F.when(F.col("w2").isNull(), F.col("c1")).otherwise(code), F.coalesce(text, F.concat("w1", lang))
            pair = code
        out += [code, F.when(code.isNull(), text)]
        code = pair if k == 2 else code
    return rows.select(F.stack(F.lit(max_n - 1), *out).alias("code", "key")).where("code is not null or key is not null")


def phrase_counts(docs: DataFrame, max_n: int, min_count: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f), stored: single words, and longer phrases of at least ``min_count`` occurrences.

    A word's count is the sum over the pairs that it begins and the pieces that it ends, so single words are exploded
    from the counts of pairs, not from the texts.  Numbers become words again once few rows are left.
    """
    known = numbered_words(docs, lang_col, text_col)
    counts = ngram_rows(docs, known, max_n, lang_col, text_col).groupBy("code", "key").agg(F.count("*").alias("f"))
    phrase, lang = F.substring_index("key", "\t", 1), F.expr("substr(key, instr(key, '\t'))")  # words hold no tab
    word, pair = F.substring_index(phrase, " ", 1), F.substring_index(phrase, " ", 2)
    mask = (1 << ID_BITS) - 1
    first, upto_pair = F.col("code").bitwiseAND(F.lit(mask)), F.col("code") < F.lit(1 << 2 * ID_BITS)
    none = F.array().cast("array<struct<code:long,key:string>>")
    row = lambda c, k: F.array(F.struct(c.alias("code"), k.alias("key")))
    often = (F.col("f") >= min_count) & F.when(F.col("code").isNull(), word != phrase).otherwise(first != F.col("code"))
    begins = F.when(F.col("code").isNull(), pair == phrase).otherwise(upto_pair)
    out = F.concat(F.when(often, row(F.col("code"), F.col("key"))).otherwise(none), F.when(begins, row(first, F.concat(word, lang))).otherwise(none))
    counts = counts.select("f", F.inline(out)).groupBy("code", "key").agg(F.sum("f").alias("f"))
    for k in range(1, min(max_n, CODED) + 1):
        said = F.broadcast(known.select(F.col("id").alias(f"c{k}"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 1 else [])))
        counts = counts.withColumn(f"c{k}", F.shiftright("code", ID_BITS * (k - 1)).bitwiseAND(F.lit(mask))).join(said, f"c{k}", "left")
    spelled = F.concat(F.concat_ws(" ", *(f"w{k}" for k in range(1, min(max_n, CODED) + 1))), F.lit("\t"), F.col("lang"))
    counts = counts.select(F.coalesce("key", spelled).alias("key"), "f").groupBy("key").agg(F.sum("f").alias("f"))  # a word may come in both forms
    words = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1
    return stored(counts.select(F.substr(lang, F.lit(2)).alias("lang"), phrase.alias("phrase"), words.alias("words"), "f"), "phrase-counts")


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, top: int = 2000, absorbed_percent: int = 50, lang_col: str = "lang", text_col: str = "text", broadcast_counts: int = BROADCAST_COUNTS) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_n`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase (at least ``min_count``), ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all
    words of the language; the score is floor(10^6 * a * a / (l * r)) in decimals of 38 digits, equal scores of cuts go
    to the earlier one.  Phrases are dropped if a longer candidate holds ``absorbed_percent`` or more of their
    occurrences.  Ranked by score, a, then the phrase's bytes.

    A null text is empty, a null language ``und``; empty texts and tables have no phrases.  Repeated rows count each.
    A text is one row however long; other columns are not read.
    """
    counts = phrase_counts(docs, max_n, min_count, lang_col, text_col)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= min_count).select("lang", "phrase", "words", "f")
    small = small_enough(often, broadcast_counts)
    near = F.broadcast if small else (lambda t: t)
    found = often.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    # a word that begins or ends many phrases is one key of a join of counts, which Spark splits where it is skewed
    side = lambda name, f: near(often.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    square = (wide("a") * wide("a")).cast("decimal(31,0)")
    cuts = cuts.withColumn("aa", F.lit(1_000_000).cast("decimal(7,0)") * square).withColumn("lr", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("aa div lr"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # (lang, shorter phrase, most occurrences in a phrase of one word more)
    shorter = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = found.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    scored, longer = scored.alias("s"), near(longer).alias("x")
    same = (F.col("s.lang") == F.col("x.lang")) & (F.col("s.phrase") == F.col("x.phrase"))
    kept = scored.join(longer, same & (100 * F.col("x.held") >= absorbed_percent * F.col("s.a")), "left_anti")
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    best = kept.withColumn("salt", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(near(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
