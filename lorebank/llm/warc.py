r"""A content-addressed archive of WARC records.

Three parts lie in one folder: ``payloads`` holds each distinct payload once under its SHA-256 digest,
``headers`` holds the exact header block of every record with the digest of the payload that it names,
and the records come back by joining the two. Among records with equal payloads (of at least
``min_revisit_bytes``), the one with the largest record id is a ``response`` and holds the payload;
the others are ``revisit`` records that refer to it. Digests are verified when the archive is read.

Which record is the response is settled on digests, ids and lengths alone. Payload bytes go through one
shuffle, by digest: equal bytes are equal whichever row they come from, so the copies that a task holds are
merged before it, and a payload that a third of the rows share arrives once from each task.

An id is percent-encoded in its URN, and so is a URL that has blanks, controls or ``<>`` (a field of its own
says so; other URLs stay as they are), so every field is one line and is read back exactly.

Defined cases: a null payload is empty; a null id sorts below all others and is written as a record id of
its own kind; a null URL has no field; of repeated rows exactly one can be the response; an empty table
gives an empty archive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.llm.common import durable, fresh_folder

CRLF = "\r\n"
#: The digits of base 32 as conv() writes them, and those of RFC 4648.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), CONV_DIGITS, RFC_DIGITS)


def _urn(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit("<urn:no-page>"))


def _header(record_type: Column, page_id: Column, url: Column, date: Column, payload_sha1: Column, length: Column, refers_to: Column) -> Column:
    """The exact header block."""
    odd, nothing = url.rlike(r"[\x00-\x20\x7F<>]"), F.lit("")
    target = F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), F.when(odd, F.concat(F.url_encode(url), F.lit(f"{CRLF}X-Target-URI-Encoding: percent"))).otherwise(url))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), record_type,
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(page_id),
        F.coalesce(target, nothing),
        F.lit(f"{CRLF}WARC-Date: "), date,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), payload_sha1,
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}X-Payload-Length: "), length.cast("string"),
        F.when(record_type == "revisit", F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn(refers_to))).otherwise(nothing),
        F.lit(f"{CRLF}Content-Length: "), F.when(record_type == "revisit", F.lit("0")).otherwise(length.cast("string")),
        F.lit(CRLF + CRLF),
    )


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> str:
    """Write one record per row; returns the archive's folder in the shared storage."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = durable(
        rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("length")).withColumn("uid", F.monotonically_increasing_id())
    )
    # max over structs: a null id comes first, and among repeated rows the largest row id decides.
    best = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "uid")).alias("best")).select("digest", F.col("best.page_id").alias("holder"), F.col("best.uid").alias("holder_uid"))
    best = durable(best)
    record_type = F.when((F.col("uid") == F.col("holder_uid")) | (F.col("length") < min_revisit_bytes), "response").otherwise("revisit")
    heads = narrow.join(best, "digest").withColumn("kind", record_type)
    heads.select(_header(F.col("kind"), F.col("page_id"), F.col("url"), F.lit(date), F.col("sha1"), F.col("length"), F.col("holder")).alias("header"), "digest", F.col("page_id").isNull().alias("no_id")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    store = rows.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _page_id(name: str) -> Column:
    """The id of a field's URN; null if it names no page."""
    named = _field(name).startswith("<urn:page:")
    return F.when(named, F.url_decode(F.regexp_extract(_field(name), "^<urn:page:(.*)>$", 1)))


def _url() -> Column:
    url = F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r]*)\r\n", 1)
    given = F.contains(F.col("header"), F.lit(f"{CRLF}WARC-Target-URI: "))
    return F.when(given, F.when(_field("X-Target-URI-Encoding") == "percent", F.url_decode(url)).otherwise(url))


def read_archive(spark: SparkSession, folder: str, id_type: str = "long", with_url: bool = False) -> DataFrame:
    """One row per record, from the header block and the stored payload that it names.

    ``verified`` says that the payload hashes to both its address and the header's digest. The URL comes
    along on request.
    """
    heads = spark.read.parquet(f"{folder}/headers")
    store = spark.read.parquet(f"{folder}/payloads").select(
        "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), (F.sha2("payload", 256) == F.col("digest")).alias("intact")
    )
    return heads.join(store, "digest", "left").select(
        _page_id("WARC-Record-ID").cast(id_type).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _page_id("WARC-Refers-To").cast(id_type).alias("refers_to"),
        (F.col("intact") & (F.concat(F.lit("sha1:"), "sha1") == _field("WARC-Payload-Digest"))).alias("verified"),
        *([_url().alias("url")] if with_url else []),
    )


def reconstruct_records(spark: SparkSession, folder: str) -> DataFrame:
    """The exact bytes of every record: header block, payload (empty for a revisit), two line ends."""
    heads, store = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    body = F.when(_field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return heads.join(store, "digest", "left").select(_page_id("WARC-Record-ID").alias("record_id"), F.concat(F.encode("header", "UTF-8"), body, F.lit(CRLF + CRLF).cast("binary")).alias("record"))
