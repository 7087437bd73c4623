"""WARC archives with revisit resolution.

Headers alone are shuffled: (payload digest, id) gives the first record of each digest, and pages learn from that small
table whether they are a response or a revisit of one. Records are written in place as text, one row per record, by
Spark's own writer (any file system, committed by task): header block, HTTP header, payload, and the two empty lines
that end a record. Reading splits the files at the version line, so archives of any size are read in parallel, and
cuts each block by its Content-Length. A payload that holds a version line itself is carried in base64 under a
Content-Transfer-Encoding header, so the cut is always right.

A revisit has the digest and length of the full payload, WARC-Refers-To and no payload. Record ids are made from the
page's id; rows that share one get the same id.

Defined cases: a null html is an empty payload; null ids come last and null urls leave the header out; line ends in
urls are percent-encoded; payloads under ``least`` bytes are all responses; rows that share the smallest id of a
payload (repeated rows, or only null ids) are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import common as C

LEAST = 100
VERSION = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, response_id, n_rows) of every payload that more than one record carries."""
    heads = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    heads = heads.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    firsts = heads.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n_rows"))
    return firsts.where("n_rows > 1")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, firsts: DataFrame, least: int = LEAST) -> DataFrame:
    """One column ``value`` with a whole record per page."""
    payload = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "size": F.octet_length("payload")}
    )
    # whether this is broadcast is Spark's choice by the size of the written table
    of = firsts.select(F.col("digest").alias("of_"), "response_id")
    row = payload.join(of, payload["digest"] == of["of_"], "left")
    revisit = F.col("of_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    row = row.withColumn("revisit", revisit)
    coded = F.contains(F.concat("payload", F.lit(_END)), F.lit(VERSION))
    row = row.withColumn("coded", coded & ~F.col("revisit"))
    body = F.when(F.col("revisit"), F.lit("")).when(F.col("coded"), F.base64(F.encode("payload", "UTF-8"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(F.col("coded"), F.lit("Content-Transfer-Encoding: base64\r\n")).otherwise(F.lit("")),
        F.lit("Content-Length: "),
        F.col("size"),
        F.lit(_END),
    )
    row = row.withColumns({"body": body, "http": http})
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("revisit"), _record_id(F.col("response_id")))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.lit(_DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", refers),
        _header("WARC-Profile", profile),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("http") + F.octet_length("body")),
        F.lit("\r\n"),
    )
    return row.select(F.concat(head, "http", "body").alias("value"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write a deduplicated archive of ``pages`` (page_id, url, html)."""
    firsts = C.written(resolve(pages, least), "firsts")
    records(pages, firsts, least).write.option("lineSep", _END).text(folder)


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Records of an archive: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    pieces = spark.read.option("lineSep", VERSION).text(folder).where(F.length("value") > 0)
    cut = pieces.withColumn("cut", F.instr("value", _END)).select(
        F.concat(F.lit("\r\n"), F.expr("left(value, cut + 1)")).alias("head"), F.expr("substring(value, cut + 4)").alias("rest")
    )

    def field(name: str, of: str = "head") -> Column:
        found = F.regexp_extract(of, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        found = F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1)
        return F.when(~found.isin("", "none"), found).cast(id_type)

    # lengths count bytes, so the block is cut as bytes
    block = F.expr("substring(cast(rest as binary), 1, cast(length as int))")
    rows = cut.withColumn("length", field("Content-Length")).withColumn("block", block.cast("string"))
    rows = rows.withColumn("at", F.instr("block", _END)).withColumns(
        {"http": F.concat(F.lit("\r\n"), F.expr("left(block, at + 1)")), "body": F.expr("substring(block, at + 4)")}
    )
    coded = field("Content-Transfer-Encoding", "http") == "base64"
    payload = F.when(coded, F.decode(F.unbase64("body"), "UTF-8")).otherwise(F.col("body"))
    kind = field("WARC-Type")
    return rows.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
        field("Content-Length", "http").cast("bigint").alias("stated_bytes"),
        F.when(kind == "response", payload).alias("payload"),
    ).select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        # of responses from the bytes that were read
        F.coalesce(F.sha2("payload", 256), "stated_digest").alias("payload_digest"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "stated_bytes").alias("payload_bytes"),
        "payload",
    )


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to the shared folder and read the records back."""
    folder = C.shared_folder(pages.sparkSession, "warc")
    write(pages, folder, least)
    return read(pages.sparkSession, folder, dict(pages.dtypes)["page_id"])
