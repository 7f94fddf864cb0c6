"""Allow and block rules for URLs: expressions of a URL looked up by short hashes, then confirmed.

A rule is a host and the beginning of a path; it fits its host and all subdomains.  Each URL is expanded into the
suffixes of its host at dots times the prefixes of its path at slashes, as many of both as any rule has.  Rules and
expressions meet by the first 32 bits of their digests; then whole digests and the rest of the rule's path are
compared, and the longest rule wins.  Built-in expressions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_enough

#: Rules up to this number go to all tasks, at some 200 bytes each; more of them are joined by a salted shuffle.
BROADCAST_RULES = 100_000
SALTS = 16
SHORT = 8  # hex digits


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns; both are empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _hashed(df: DataFrame, expression: Column) -> DataFrame:
    df = df.withColumn("digest", F.sha2(expression, 256))
    return df.withColumn("short", F.substring("digest", 1, SHORT))


def rule_table(rules: DataFrame) -> DataFrame:
    """(short, digest, rule_host, rule_path, block): a rule under the digest of its host and its path up to the last slash.

    A null host or path is empty; a rule is read once however often it stands there.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = rules.select(lower_ascii(text("host")).alias("rule_host"), text("path").alias("rule_path"), (F.col("verdict") == "block").alias("block"))
    one = one.groupBy("rule_host", "rule_path").agg(F.max("block").alias("block"))
    upto = F.regexp_extract("rule_path", r"(?s)^(?:.*/)?", 0)
    return _hashed(one, F.concat("rule_host", upto)).select("short", "digest", "rule_host", "rule_path", "block")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Host, path, the longest rule that fits and its verdict, for each row of ``pages``.

    ``rules`` has the columns verdict (allow or block), host, path.  A rule fits if the host equals its own or ends
    with a dot and its own, and the path starts with its own.  The longest rule (host and path together) wins, then
    the longer host; of the same rule with both verdicts the block.  Without a fitting rule ``rule`` is null and the
    verdict ``default``: what stands on no list is let through.

    A null url has an empty host and path.  Repeated rows and null ids are answered row for row; an empty table gives
    an empty one; other columns are not read.  However many dots or slashes a URL has, it is expanded no further
    than the rules go, as longer expressions can equal none of them.
    """
    hashed = rule_table(rules)
    dots = F.size(F.split("rule_host", r"\.", -1))
    most = hashed.agg(F.max(dots).alias("labels"), F.max(_slashes(F.col("rule_path"))).alias("slashes")).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most["labels"] or 1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    cut = F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(most["slashes"] or 0)))
    rows = rows.select("page_id", "host", "path", F.posexplode(suffixes).alias("i", "suffix"))
    rows = rows.select("page_id", "host", "path", "i", "suffix", F.explode(cut).alias("k"))
    prefix = F.when(F.col("k") == 0, F.lit("")).otherwise(F.expr("concat(substring_index(path, '/', k), '/')"))
    rows = _hashed(rows, F.concat("suffix", prefix)).select("page_id", "host", "path", ((F.col("i") == 0) & (F.col("k") == 0)).cast("int").alias("first"), "short", "digest")
    if small_enough(hashed, broadcast_rules):
        met = rows.join(F.broadcast(hashed.withColumnRenamed("digest", "whole")), "short", "left")
    else:  # the expression of one large host is dealt over salts
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
        salted = hashed.withColumnRenamed("digest", "whole").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(salted, ["short", "salt"], "left")
    fits = (F.col("digest") == F.col("whole")) & F.startswith("path", "rule_path")
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.when(fits, F.struct(F.length(rule).alias("long"), F.length("rule_host").alias("long_host"), "block", rule.alias("rule"))))
    # equal rows are counted and written out again, so that they are one group whatever their number
    out = met.groupBy("page_id", "host", "path").agg(best.alias("best"), F.sum("first").cast("int").alias("n"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow"))
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "n")
    return out.select("page_id", "host", "path", "rule", "verdict", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")
