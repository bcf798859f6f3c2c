"""Content-addressed web archive (operator 1).

An archive is two tables: ``records`` keeps the exact header block of every record, ``payloads`` keeps
each payload's bytes once under its SHA-256.  A record is header, payload, two line ends; reading joins
the two tables again, after the stored bytes have proved their address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
LEAST_REVISIT = 1000  # smaller payloads are always stored as responses


def _one_line(value: Column) -> Column:
    """Header values have no line ends of their own: percent-encode them."""
    for plain, code in (("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def to_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Header and payload of one record per page: page_id, header, address (SHA-256), payload.

    Of equal payloads of ``least_revisit`` bytes or more the page with the largest id is the response;
    pages with a null id are smallest, and rows that repeat the response's id are responses too.  A null
    html is an empty payload, a null url leaves out its header.  Other columns are not read.
    """
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    # everything a header says of the payload is worked out before the join, which then need not carry it
    plain = plain.withColumns({"address": F.sha2("payload", 256), "_sha1": F.sha1("payload"), "_bytes": F.octet_length("payload")})
    large = F.col("_bytes") >= least_revisit
    first = plain.where(large).groupBy("address").agg(F.max("page_id").alias("_owner"))
    first = first.withColumnRenamed("address", "_address")
    rows = plain.join(first, (F.col("address") == F.col("_address")) & large, "left")
    response = F.col("_address").isNull() | F.col("page_id").eqNullSafe(F.col("_owner"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", _one_line(F.col("url")))),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To", name(F.col("_owner"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.when(response, F.col("_bytes")).otherwise(0).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", header.alias("header"), "address", "payload")


def write_archive(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Write the two tables of the archive below ``path``; tasks send each payload they have once."""
    to_records(pages, least_revisit).select("header", "address").write.parquet(f"{path}/records")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("address"), "payload").dropDuplicates(["address"]).write.parquet(
        f"{path}/payloads"
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records put together again: header, payload, its SHA-1 and bytes, and the header's fields.

    page_id, url, record_type, refers_to and payload_digest come from the header text.  A payload that
    does not have its address, or whose digest is not the header's, is an error, never a silent row.
    """
    records = spark.read.schema("header string, address string").parquet(f"{path}/records")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    proved = F.sha2("payload", 256) == F.col("address")
    payload = F.when(proved, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its address")).cast("binary"))
    payloads = payloads.select(F.col("address").alias("_address"), payload.alias("payload"))
    payloads = payloads.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("_sha1", F.sha1("payload"))
    field = lambda key: F.regexp_extract("header", rf"\r\n{key}: ([^\r]*)\r\n", 1)
    number = lambda key: F.regexp_extract("header", rf"\r\n{key}: <urn:x-page:(-?\d+)>", 1).try_cast("long")
    joined = records.join(payloads, records.address == payloads._address, "left")
    digest = F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("_sha1")), F.col("_sha1"))
    return joined.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(field("WARC-Target-URI") != "", field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        digest.otherwise(F.raise_error(F.lit("a payload does not have its header's digest"))).alias("payload_digest"),
        "payload_bytes", "header", "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """The exact bytes of each record of :func:`read_archive`: revisits carry no payload."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), body, end).alias("record"))


def write_warc_files(records: DataFrame, path: str) -> None:
    """Plain WARC files, one per partition, for other tools."""
    record_bytes(records).select(F.expr("decode(substr(record, 1, octet_length(record) - 4), 'UTF-8')").alias("value")).write.option(
        "lineSep", "\r\n\r\n"
    ).text(path)
