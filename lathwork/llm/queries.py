"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, decontamination, filter_audit, id_codec, jaccard_join, packing, pii, token_counts, toxicity, url_rules, warc
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("key", "check")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "longest")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_codec.coded_ids(table(spark, sf_dir, "documents"))


def op8_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select -1L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_check(conversations.unionByName(own))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_personal_data": op4_personal_data,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_token_ids": op7_token_ids,
    "op8_vantage_points": op8_vantage_points,
    "op9_chat": op9_chat,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_url_rules": op12_url_rules,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
                     max(page_id) OVER (PARTITION BY html) AS holder FROM p)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> holder THEN holder END AS refers_to, true AS verified
        FROM d
    """,
    "op8_vantage_points": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op9_chat": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                     sum(32 + length(replace(replace(role, '^', '^^'), '<|', '<^|')) + length(replace(replace(text, '^', '^^'), '<|', '<^|'))) OVER w AS upto
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars,
               count(*) FILTER (role = 'assistant') AS n_examples
        FROM n GROUP BY conv_id
    """,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
        n AS (SELECT t.doc_id, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS seen FROM t UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.seen)
        SELECT doc_id, any_value(n.n) AS n_shingles, min(seen) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op11_filter_interactions": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT doc_id, part, unnest([{'f': 'A', 'x': len(w) < 100}, {'f': 'B', 'x': 100 * len(list_distinct(w)) < 80 * len(w)},
                     {'f': 'C', 'x': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)}, {'f': 'D', 'x': regexp_matches(text, '[#$%&*|]')},
                     {'f': 'E', 'x': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}]) AS u FROM w),
        d AS (SELECT f.doc_id, part, coalesce(string_agg(u.f, '' ORDER BY u.f) FILTER (u.x), '') AS failed FROM f GROUP BY ALL),
        m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
                     count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM d GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, k::INTEGER AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) r(k)),
        r AS (SELECT part, filter_order, step, x,
                     coalesce(sum(n) FILTER (NOT contains(failed, x) AND translate(failed, before, '') = failed), 0)::BIGINT AS kept,
                     coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, before, '') = failed), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, before, '') <> failed), 0)::BIGINT AS redundant,
                     coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (contains(failed, x) AND translate(failed, before, '') = failed), 0)::BIGINT AS good_lost,
                     coalesce(sum(toxic) FILTER (contains(failed, x) AND translate(failed, before, '') = failed), 0)::BIGINT AS toxic_lost
              FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r
    """,
    "op12_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
        h AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        j AS (SELECT k, page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
              FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j
    """,
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, range(1, 4) t(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        x AS (SELECT c.lang, c.k, c.phrase, c.a, j.f AS l, r.f AS r, i, (1000000::HUGEINT * c.a * c.a) // (j.f::HUGEINT * r.f) AS score
              FROM c, range(1, 3) t(i) JOIN f j ON j.lang = c.lang AND j.phrase = array_to_string(c.w[1:i], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[i + 1:], ' ') WHERE i < c.k),
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 50 * b.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM d JOIN n USING (lang) QUALIFY rank <= 2000
    """,
}
