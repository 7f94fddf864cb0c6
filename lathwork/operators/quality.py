"""Contracts: dangling keys, duplicates, ranges, leakage, quarantine, and fingerprints of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(df: DataFrame, key: str, other: DataFrame, other_key: str, reason: str, id_col: str) -> DataFrame:
    """(reason, id) of rows whose key, where set, is not in the other table."""
    k = other.select(F.col(other_key).alias("_k"))
    return df.where(F.col(key).isNotNull()).join(k, df[key] == k["_k"], "left_anti").select(F.lit(reason).alias("reason"), F.col(id_col).cast("string").alias("id"))


def duplicates(df: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """(reason, id) of keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(reason).alias("reason"), F.concat_ws("|", *keys).alias("id"))


def broken(df: DataFrame, rule: Column, reason: str, id_col: str) -> DataFrame:
    """(reason, id) of rows that break the rule; a rule that is null counts as broken."""
    return df.where(~F.coalesce(rule, F.lit(False))).select(F.lit(reason).alias("reason"), F.col(id_col).cast("string").alias("id"))


def report(findings: Sequence[DataFrame]) -> DataFrame:
    """Findings counted by reason, with the smallest id as an example."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("example"))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    why = F.filter(F.array(*(F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", why)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def leakage(train: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both sides hold."""
    return train.select(*keys).intersect(holdout.select(*keys))


def fingerprint(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """Per key the SHA-256 of its rows' digests in sorted order, so order and partitioning do not matter.

    The digests of a key are one value: for keys of some hundred thousand rows.  For larger ones use :func:`fingerprint_of_many`.
    """
    digests = df.select(*keys, F.sha2(row, 256).alias("_d"))
    return digests.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("fingerprint"), F.count("*").alias("n"))


def fingerprint_of_many(df: DataFrame, keys: Sequence[str], row: Column, nibbles: int = 3) -> DataFrame:
    """The same in two levels, for keys of any size: digests are digested by their first hex digits (4,096 ranges at
    three), then the ranges of a key in order.  More rows want more digits: a range should hold some hundred thousand."""
    digests = df.select(*keys, F.sha2(row, 256).alias("_d"))
    ranges = digests.groupBy(*keys, F.substring("_d", 1, nibbles).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_r"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_r"))), lambda x: x["_r"])
    return ranges.groupBy(*keys).agg(F.sha2(F.array_join(ordered, ""), 256).alias("fingerprint"), F.sum("_n").alias("n"))
