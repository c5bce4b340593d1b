"""A content-addressed web archive.

Every page becomes a WARC/1.1 record. Payload bytes are stored once for each SHA-256 digest; the exact record headers are
stored apart, with the digest. Records are rebuilt by joining the two, after each payload's digest has been computed
afresh from its stored bytes. On writing, equal digests must also agree in length and CRC-32, or the write fails.

Of records with equal payloads of at least LEAST bytes the one with the smallest page_id is a response, the others are
revisits that refer to it.

Tables (Parquet, in the folder given): headers (digest, header), payloads (digest, payload); facts and firsts, from which
headers are made. Joins by digest deal the rows of a digest that many pages share over several tasks.

Defined results: null html is an empty payload; null url is an empty target; line breaks in a url become spaces; rows with
null page_id are revisits if a numbered page has the payload, else responses; rows repeated with one page_id and payload
are alike (both responses if they are the first); an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_salted, new_path

LEAST = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _facts(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(page_id: Column, url: Column, digest: Column, n_bytes: Column, refers_to: Column, date: str = DATE) -> Column:
    """The record header: a revisit (refers_to is given) has no block of its own."""
    revisit = refers_to.isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _urn(refers_to)))).otherwise(""),
        _line("Content-Type", "text/html"),
        _line("Content-Length", F.when(revisit, "0").otherwise(n_bytes.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """Write the headers and payloads tables under path.

    Payloads cross one shuffle, only those that are stored, by page; the digests' groups are summed before theirs.
    """
    spark = pages.sparkSession
    facts = _facts(pages, page_id, url, html)
    # Payloads are read twice: here for their facts, and below for those that are stored.
    known = facts.select("page_id", "url", "digest", "n_bytes", F.crc32("payload").alias("crc"))
    known.write.parquet(f"{path}/facts")
    known = spark.read.schema(known.schema).parquet(f"{path}/facts")
    spans = [F.min("page_id").alias("first"), *(f(x).alias(n) for f, x, n in ((F.min, "crc", "c0"), (F.max, "crc", "c1"), (F.min, "n_bytes", "b0"), (F.max, "n_bytes", "b1")))]
    firsts = known.groupBy("digest").agg(*spans)
    equal = (F.col("c0") == F.col("c1")) & (F.col("b0") == F.col("b1"))
    checked = F.when(equal, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two payloads of digest "), F.col("digest"))))
    firsts = firsts.select(checked.alias("digest"), "first")
    firsts.write.parquet(f"{path}/firsts")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/firsts")

    heads = join_salted(known.select("page_id", "url", "digest", "n_bytes"), firsts, "digest", hot_keys(known, "digest"))
    other = (F.col("n_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    text = header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n_bytes"), F.when(other, F.col("first")))
    heads.select("digest", text.cast("binary").alias("header")).write.parquet(f"{path}/headers")

    # Pages without a number share a key: each takes one of many by its payload.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.concat(F.lit("-"), "digest"))
    chosen = facts.select(key("page_id").alias("key"), "digest", "payload").join(
        firsts.select(key("first").alias("key"), "digest"), ["key", "digest"], "left_semi"
    )
    # Rows repeated with one page_id and payload: one of them; each task keeps one before the shuffle.
    once = chosen.groupBy("key", "digest").agg(F.first("payload").alias("payload"))
    once.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, n_bytes) of every stored payload; fails if the bytes do not have the digest."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    fresh = F.sha2("payload", 256)
    bad = F.raise_error(F.concat(F.lit("payload is damaged: "), F.col("digest")))
    return stored.select(
        F.when(fresh == F.col("digest"), fresh).otherwise(bad).alias("digest"), "payload", F.octet_length("payload").cast("long").alias("n_bytes")
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every archived record, rebuilt: header, record (its exact bytes), payload (a revisit's too), digest, n_bytes."""
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    joined = join_salted(headers, payloads(spark, path), "digest", hot_keys(headers, "digest"))
    block = F.when(F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    end = F.lit(CRLF + CRLF).cast("binary")
    return joined.withColumn("record", F.concat("header", block, end))


def field(header: Column, name: str) -> Column:
    """A header field's value, null if it is not there."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archive."""
    text = F.col("header").cast("string")
    number = lambda name: F.regexp_extract(field(text, name), r"<urn:page:(-?\d+)>", 1)
    long = lambda c: F.when(c != "", c).cast("long")
    return records(spark, path).select(
        long(number("WARC-Record-ID")).alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        field(text, "WARC-Type").alias("record_type"),
        long(number("WARC-Refers-To")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and report on the records read back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return page_report(pages.sparkSession, path)
