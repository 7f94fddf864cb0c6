"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.

In every stage a null text counts as an empty one and stays null, a null doc_id stays null, a null in any other
column is passed on, further columns whatever their names are passed on, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathwork.llm import decontamination, jaccard_join, packing, pii, toxicity
from lathwork.llm.shared import small_enough, stored, table, tidy


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5; it learns from the labels of those it is given.

    Empty and null texts get the machine's bias, which is under 0.5 where most labels are 0, and a very long text one
    score for all of it.  Equal rows stay or go together.  Without labels the score is 0.5 for all, so all would
    go: then all stay, as nothing speaks against any.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more on five-word shingles, the smallest doc_id stays.

    Texts without words link with nothing and all stay.  Of equal rows one stays; a null doc_id goes if its group
    has another.
    """
    groups = jaccard_join.jaccard_components(docs, words=5, percent=80).select("doc_id", "key", "component_id", "n_shingles")
    groups = stored(groups, "groups")
    named = [F.col("doc_id").alias("_id"), F.col("key").alias("_key")]
    extra = groups.where("n_shingles > 0 and not doc_id <=> component_id").select(*named).distinct()
    # different texts under the one id that a group is named by: the one of the smallest key stays
    lead = groups.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("_lead"), F.max("key").alias("_last")).where("_lead <> _last")
    also = groups.where("n_shingles > 0 and doc_id = component_id").join(lead.select("doc_id", "_lead"), "doc_id").where("key <> _lead")
    extra = extra.unionByName(also.select(*named).distinct())
    again = groups.where("n_shingles > 0 and doc_id <=> component_id").groupBy("doc_id", "key").count().where("count > 1").select(*named)
    extra, again = stored(extra, "extra"), stored(again, "again")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    is_in = lambda t: docs["doc_id"].cast("long").eqNullSafe(t["_id"]) & (key == t["_key"])
    # ids and keys of a hundred bytes or less go to every task up to a million; beyond that the documents move once
    if small_enough(extra, 1_000_000):
        extra = F.broadcast(extra)
    kept = docs.join(extra, is_in(extra), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, is_in(again), "left_anti")
    return once.unionByName(kept.join(again, is_in(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by half or more.

    Equal rows stay or go together; empty texts hold no item; with an empty benchmark all stay.
    """
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; equal rows are masked alike, and n_chars follows the text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2,048 tokens and its place in a sequence; equal rows are packed each, an empty text is the end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack),
]

#: A trained model, tilings and a packing are beyond SQL; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
