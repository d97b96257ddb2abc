"""Content-addressed WARC archive (operator 4).

Payload bytes are stored once under their SHA-256, the exact header of every
record stays in a table of its own, and records are put together again by
joining the two.  Reading recomputes the digest of every payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DATE = "2024-01-01T00:00:00Z"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_REVISIT = 0  # payloads of at least so many bytes are stored as response and revisits


def base32(hexes):
    """Base32 of a 40-digit hexadecimal digest: ten digits are eight letters."""
    parts = [F.lpad(F.conv(F.substring(hexes, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _line(name: str, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write ``folder/payloads`` (digest, payload) and ``folder/headers`` (digest, header).

    Of records with equal payloads of at least ``min_revisit`` bytes, the one
    with the largest page_id is the response; the others revisit it.  Rows that
    repeat that page_id are responses too.  NULL html is an empty payload; a
    NULL id sorts below all others and is written as an empty one; line breaks
    in a URL are percent-encoded.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("bigint"),
    })
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("sha1").alias("low"), F.max("sha1").alias("high"))
    same = F.assert_true(F.col("low") == F.col("high"), F.lit("two payloads share a SHA-256"))
    stored.filter(same.isNull()).select("digest", "payload").write.parquet(f"{folder}/payloads")
    facts = rows.select("page_id", "url", "digest", "sha1", "bytes")
    owners = facts.groupBy("digest").agg(F.max("page_id").alias("owner"))
    joined = facts.join(owners, "digest")
    revisit = (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", ident("page_id")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _line("WARC-Refers-To", F.when(revisit, ident("owner"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"))
    joined.select("digest", header.alias("header")).write.parquet(f"{folder}/headers")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/payloads")
    whole = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload does not match its digest"))
    return rows.filter(whole.isNull())


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/headers")


def field(name: str):
    """The value of a header line; NULL if there is none."""
    found = F.regexp_extract(F.col("header"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as it stands in a WARC file, with its header and its full payload."""
    rows = _headers(spark, folder).join(_payloads(spark, folder), "digest")
    block = F.when(field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    end = F.lit("\r\n\r\n").cast("binary")
    return rows.select("header", "payload", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per record its fields, with length and digest recomputed from the stored payload."""
    facts = _payloads(spark, folder).select(
        "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    rows = _headers(spark, folder).join(facts, "digest")
    told = F.substring(field("WARC-Payload-Digest"), 6, 32)
    agrees = F.assert_true(told == F.col("payload_digest"), F.lit("a header's digest does not match its payload"))
    number = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d*)>", 1)
    return rows.filter(agrees.isNull()).select(
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID").cast("bigint")).alias("page_id"),
        "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"),
        F.when(number("WARC-Refers-To") != "", number("WARC-Refers-To").cast("bigint")).alias("refers_to"))


def op4_warc(spark, folder: str) -> DataFrame:
    archive = C.shared_folder(spark)
    write_archive(spark.read.parquet(f"{folder}/pages.parquet"), archive)
    return read_index(spark, archive)


ORACLE = """
with rows as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as h from pages),
owners as (select payload, max(page_id) as owner from rows group by payload)
select page_id, cast(octet_length(rows.payload) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
    (cast(('0x' || substr(h, 10 * (i // 8) + 1, 10)) as bigint) >> (5 * (7 - i % 8))) & 31 as integer) + 1, 1)),
    'string_agg', '') as payload_digest,
  case when page_id = owner then 'response' else 'revisit' end as record_type,
  case when page_id <> owner then owner end as refers_to
from rows join owners using (payload)"""
