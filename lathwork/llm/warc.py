"""Content-addressed archive of WARC records.

Two Parquet datasets in the shared folder: ``payloads`` holds each payload's bytes once, under its SHA-256, in
buckets by that address; ``records`` holds every record's exact head (version line to the blank line) and the address
of its payload.  Original records come back by joining the two, in place on the side of the payloads.  What an archive
says is read from the records that the join gives back: version line, fields, length and bytes of the block; payloads
are digested again, and a record whose bytes do not give its address and its own digest is not verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stored

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are twenty bits are four letters."""

    def letters(i: Column) -> Column:
        bits = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        pick = lambda shift: F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        return F.concat(pick(15), pick(10), pick(5), pick(0))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its address, record type, the page it refers to, and its exact head; no payload."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.sha2(html, 256).alias("address"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    p = stored(p, "pages")
    # equal bytes: the same address, SHA-1 and length; the largest page_id answers for all
    same = p.where(F.col("bytes") >= least_bytes).groupBy("address", "sha1", "bytes").agg(F.max("page_id").alias("holder"))
    p = p.join(same, ["address", "sha1", "bytes"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    p = p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("holder")))
    digest = base32_of_hex(F.col("sha1"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type"),
        F.lit(CRLF + "WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(CRLF + "WARC-Target-URI: "), url,
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Refers-To: "), name(F.col("refers_to")), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(CRLF + CRLF),
    )
    return p.select("page_id", "address", "record_type", F.col("refers_to"), head.cast("binary").alias("head"))


def write_archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, str]:
    """Writes the two datasets; returns their paths.  A null page_id or url is allowed, a null html is empty.

    Repeated rows of one page_id and payload are one response, as none of them is another page.  Payloads move
    through one shuffle, by address, after each task has dropped those it has already: bytes of equal address are
    equal, so any copy will do, and copies of one payload, however many, are one row a task.
    """
    spark = pages.sparkSession
    records, payloads = new_path(spark, "records"), new_path(spark, "payloads")
    plan_records(pages, least_bytes, id_col, url_col, html_col).write.option("compression", "zstd").parquet(records)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    kept = pages.select(F.sha2(html, 256).alias("address"), html.alias("payload")).dropDuplicates(["address"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept.write.bucketBy(buckets, "address").format("parquet").option("compression", "zstd").option("path", payloads).saveAsTable(_table_of(payloads))
    return records, payloads


def _table_of(payloads: str) -> str:
    """The session's name for the bucketed files, so that it knows where addresses lie."""
    return "payloads_" + payloads.rsplit("-", 1)[-1]


def _payloads(spark: SparkSession, payloads: str) -> DataFrame:
    name = _table_of(payloads)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(payloads)


def read_records(spark: SparkSession, records: str, payloads: str) -> DataFrame:
    """page_id, address, record: the original records, byte for byte, rebuilt from head and payload."""
    heads, store = spark.read.parquet(records), _payloads(spark, payloads)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return heads.join(store.hint("merge"), "address", "left").select("page_id", "address", F.concat("head", body, F.lit(b"\r\n\r\n")).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """What each record says: page_id and address as stored, record_type, target (page_id it refers to), said (digest of its
    field), length, whether it is well formed, and size and digests of its block."""
    text = F.col("record").cast("string")
    head = F.substring_index(text, CRLF + CRLF, 1)
    rows = records.select("page_id", "address", "record", head.alias("head"), (F.octet_length(head.cast("binary")) + 4).alias("at"))
    field = lambda name, what: F.nullif(F.regexp_extract("head", f"\r\n{name}: {what}(?:\r\n|$)", 1), F.lit(""))
    length = field("Content-Length", "([0-9]+)").cast("long")
    rows = rows.select("page_id", "address", "record", "at", F.regexp_extract("head", "^WARC/1.1\r\nWARC-Type: ([a-z]+)(?:\r\n|$)", 1).alias("record_type"), field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("target"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("said"), length.alias("length"))
    block = F.expr("substring(record, at + 1, cast(length as int))")
    whole = (F.octet_length("record") == F.col("at") + F.col("length") + 4) & (F.expr("substring(record, cast(at + length + 1 as int), 4)") == F.lit(b"\r\n\r\n"))
    return rows.select("page_id", "address", "record_type", "target", "said", "length", whole.alias("whole"), F.sha1(block).alias("sha1"), F.sha2(block, 256).alias("sha256"))


def describe_archive(spark: SparkSession, records: str, payloads: str) -> DataFrame:
    """What the archive's records say: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Length and digest of a response are those of its own block.  A revisit has none: its are those of the response
    that it refers to, by page and digest.
    """
    p = stored(parsed(read_records(spark, records, payloads)), "parsed")
    digest = base32_of_hex(F.col("sha1"))
    p = p.withColumn("digest", F.when(F.col("record_type") == "response", digest))
    good = F.coalesce(F.col("whole") & (F.col("digest") == F.col("said")) & (F.col("sha256") == F.col("address")), F.lit(False))
    answers = p.where("record_type = 'response'").select("page_id", "address", "length", "digest", good.alias("good"))
    held = answers.groupBy(F.col("page_id").alias("target"), F.col("digest").alias("said")).agg(F.max("length").alias("_length"), F.min("good").alias("_good"))
    own = answers.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("good").alias("verified"))
    again = p.where("record_type = 'revisit'").select("page_id", "target", "said", "whole", "length").alias("r")
    again = again.join(held.alias("h"), F.expr("r.target <=> h.target and r.said = h.said"), "left")
    empty = F.col("whole") & (F.col("length") == 0) & F.col("_good")
    again = again.select("page_id", F.col("_length").alias("payload_bytes"), F.when(F.col("_length").isNotNull(), F.col("r.said")).alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("r.target").alias("refers_to"), F.coalesce(empty, F.lit(False)).alias("verified"))
    return own.unionByName(again)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes an archive of the pages and describes it from its records."""
    return describe_archive(pages.sparkSession, *write_archive(pages, least_bytes))
