"""Rule banks as data: evidence rows, rule rows, scores, the best category with its margin, or unknown."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

RULE_SCHEMA = "rule_id string, category string, base double, signals map<string,double>, required_all array<string>, required_any array<string>, threshold double"


def rule_table(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Rules as rows: signals map a key to its weight, negative ones count against."""
    filled = [{"base": 0.0, "required_all": [], "required_any": [], "threshold": 0.5} | r for r in rules]
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in RULE_SCHEMA.split(", ")) for r in filled], RULE_SCHEMA)


def strongest(evidence: DataFrame, id_col: str) -> DataFrame:
    """One strength for each subject and key, the largest; as one map per subject."""
    best = evidence.groupBy(id_col, "key").agg(F.max("strength").alias("strength"))
    return best.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "strength")))).alias("evidence"))


def _filled(rules: Sequence[dict]) -> list[dict]:
    """Rules with all their fields, in order of category and id, in which equal scores rank."""
    return sorted(({"base": 0.0, "required_all": [], "required_any": [], "threshold": 0.5} | r for r in rules), key=lambda r: (r["category"], r["rule_id"]))


def _bank(rules: Sequence[dict], more: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, needed, evidence, strengths of ``more`` keys): id, needed, and of each the best rule of all and the best score of another category."""
    bank = _filled(rules)
    keys = sorted({k for r in bank for k in (*r["signals"], *r["required_all"], *r["required_any"])})
    place = {k: n for n, k in enumerate(keys)}
    at = lambda names: [place[k] for k in names]
    widest = max(len(r["signals"]) for r in bank)
    # one place more, where no key is
    signals = np.array([at(r["signals"]) + [len(keys)] * (widest - len(r["signals"])) for r in bank])
    kinds = np.unique([r["category"] for r in bank], return_inverse=True)[1]
    names, ids, thresholds = pa.array([r["category"] for r in bank]), pa.array([r["rule_id"] for r in bank]), np.array([float(r["threshold"]) for r in bank])
    said = pa.array(keys, pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, e = batch.num_rows, batch.column(2)
            starts = e.offsets.to_numpy()
            first, last = int(starts[0]) if n else 0, int(starts[-1]) if n else 0
            row = np.repeat(np.arange(n), np.diff(starts))
            key = pc.fill_null(pc.index_in(e.keys.slice(first, last - first), value_set=said), -1).to_numpy()
            value = pc.fill_null(e.items.slice(first, last - first), 0.0).to_numpy()
            known = key >= 0
            strength, there = np.zeros((len(keys) + 1, n)), np.zeros((len(keys) + 1, n), dtype=bool)
            strength[key[known], row[known]] = value[known]
            there[key[known], row[known]] = True
            if n and more:
                table = batch.column(3).flatten()
                held, table = table.is_valid().to_numpy(zero_copy_only=False).reshape(n, -1), pc.fill_null(table, 0.0).to_numpy().reshape(n, -1)
                for i, k in enumerate(more):
                    if k in place:
                        strength[place[k]] = np.where(held[:, i], table[:, i], strength[place[k]])
                        there[place[k]] |= held[:, i]
            scores = np.full((len(bank), n), -1.0)
            for i, r in enumerate(bank):
                total = np.full(n, float(r["base"]))
                for k, w in r["signals"].items():
                    total += strength[place[k]] * float(w)
                total = np.where(np.isnan(total), 1.0, np.clip(total, 0.0, 1.0))
                ok = there[at(r["required_all"])].all(axis=0) & (total > 0)
                if r["required_any"]:
                    ok &= there[at(r["required_any"])].any(axis=0)
                scores[i, ok] = total[ok]
            top = scores.argmax(axis=0)
            best = scores[top, np.arange(n)]
            found = best > 0
            other = np.where(kinds[:, None] == kinds[top], -1.0, scores).max(axis=0, initial=-1.0)
            used = there[signals[top], np.arange(n)[:, None]] & found[:, None]
            trace = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]), pa.int32()), said.take(pa.array(signals[top][used], pa.int64())), mask=pa.array(~found))
            best_of = [pa.array(best, mask=~found), names.take(pa.array(top, mask=~found)), ids.take(pa.array(top, mask=~found)), pa.array(thresholds[top], mask=~found), trace, pa.array(other, mask=~found | (other <= 0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *best_of], names=[*batch.schema.names[:2], "score", "category", "rule_id", "threshold", "used", "other"])

    return each


def classify(subjects: DataFrame, id_col: str, rules: Sequence[dict], evidence_col: str = "evidence", margin: float = 0.08, conflict: str | None = None, conflict_margin: float = 0.18, strengths: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """id, category, score, margin, rule_id, confidence, trace, contested: the best rule of the best category.

    A rule counts if its required keys are there; its score is base plus the weighted strengths, within 0 and 1;
    each category takes its best rule.  Below the rule's threshold, or nearer than ``margin`` to the next category,
    the category is unknown; where the evidence has the key ``conflict``, nearer than ``conflict_margin`` will do for
    that.  Rules of no score don't count.  ``strengths``, if given, names an array and the keys whose strengths it holds, null
    where a key is not there, beside those of the evidence.  Rules go along with the plan, so there is no join and no shuffle; a batch of subjects
    is a table of strengths by key, to which each rule is applied at once.
    """
    e = F.col(evidence_col).cast("map<string,double>")
    needed = F.when(F.map_contains_key(e, F.lit(conflict)), conflict_margin).otherwise(margin) if conflict else F.lit(margin)
    rows = subjects.select(F.col(id_col).alias("id"), needed.cast("double").alias("needed"), e.alias("evidence"), *([F.col(strengths[0]).cast("array<double>")] if strengths else []))
    schema = StructType([*rows.schema.fields[:2]]).add("score", "double").add("category", "string").add("rule_id", "string").add("threshold", "double").add("used", ArrayType(StringType())).add("other", "double")
    rows = rows.mapInArrow(_bank(rules, list(strengths[1]) if strengths else []), schema)
    rows = rows.withColumn("gap", F.col("score") - F.coalesce("other", F.lit(0.0)))
    # compared to nine places: sums of weights in another order differ beyond them
    clear = F.col("other").isNull() | (F.round("gap", 9) >= F.col("needed"))
    sure = F.col("score").isNotNull() & (F.round("score", 9) >= F.col("threshold")) & clear
    doubt = F.least(F.greatest(1 - 0.6 * F.coalesce(F.col("score"), F.lit(0.0)), F.lit(0.25)), F.lit(0.9))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(sure, F.col("category")).otherwise("unknown").alias("category"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("gap", F.lit(0.0)).alias("margin"),
        F.when(sure, F.col("rule_id")).alias("rule_id"),
        F.when(sure, F.col("score")).otherwise(doubt).alias("confidence"),
        F.col("used").alias("trace"),
        F.coalesce(F.col("other").isNotNull() & (F.round("gap", 9) < margin), F.lit(False)).alias("contested"),
    )


def first_match(text: Column, cascade: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Ordered regular expressions: the label of the first that matches."""
    out = F.when(text.rlike(cascade[0][0]), cascade[0][1])
    for pattern, label in cascade[1:]:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(otherwise)


def exactly_one(text: Column, categories: dict[str, str]) -> Column:
    """The category if exactly one of the patterns matches, else null."""
    hits = lambda t: F.filter(F.array(*(F.when(t.rlike(p), F.lit(c)) for c, p in categories.items())), lambda x: x.isNotNull())
    # one after the other, so the text and the hits are made once, not for each pattern
    return F.transform(F.transform(F.array(text), hits), lambda h: F.when(F.size(h) == 1, h[0]))[0]


def penalties(base: float, ledger: Sequence[tuple[Column, float, str]]) -> Column:
    """A score less its penalties, the level, and the reasons, as a struct."""
    lost = F.lit(0.0)
    for when, amount, _ in ledger:
        lost = lost + F.when(when, amount).otherwise(0.0)
    score = F.least(F.greatest(F.lit(base) - lost, F.lit(0.0)), F.lit(1.0))
    reasons = F.filter(F.array(*(F.when(when, F.lit(name)) for when, _, name in ledger)), lambda x: x.isNotNull())
    level = F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")
    return F.struct(score.alias("score"), level.alias("level"), reasons.alias("reasons"))


def repeated(df: DataFrame, key: str, name: str = "repetitions") -> DataFrame:
    """How often each row's key occurs: counted once per key and joined, so a hot key is not one window."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")


def ranked_margin(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Per key the best label, its score and the lead over the second."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    lead = df.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_n = 1")
    return lead.select(*keys, label, score, (F.col(score) - F.coalesce("_next", F.lit(0.0))).alias("margin"))
