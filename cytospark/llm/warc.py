"""A content-addressed WARC archive: payload bytes once by their SHA-256, exact record headers apart.

The payload table has one row for each distinct payload; the header table has one for each record, with the exact bytes
of its headers. A record is its headers followed by its payload (a revisit: nothing), and a join on the digest gives it
back. Every payload is verified against its digest when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_path

#: Payloads of fewer bytes are kept by every record as a response of its own.
LEAST = 1000
END = "\r\n"


def record_id(page_id: Column) -> Column:
    """A record's URN, from its page."""
    h = F.sha1(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def headers_of(pages: DataFrame, date: str) -> Column:
    """The bytes before a record's payload: WARC headers, a blank line, HTTP headers, a blank line. pages has page_id, url,
    payload_bytes, sha1, record_type and refers_to. Line ends in URLs are percent-encoded."""
    url = F.replace(F.replace(F.coalesce(pages["url"], F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", pages["payload_bytes"].cast("string")), F.lit(END))
    revisit = pages["record_type"] == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(pages["payload_bytes"])
    warc = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", pages["record_type"]),
        line("WARC-Record-ID", record_id(pages["page_id"])),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), pages["sha1"])),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(pages["refers_to"])), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(END),
    )
    return F.concat(warc, http).cast("binary")


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes path/payloads and path/headers for the rows of pages (page_id, url, html; null html: empty payload). Of records
    with equal payloads of LEAST bytes or more, that with the largest page_id is the response. Rows that agree in page_id
    and payload give a record each, of the same type and under the same URN. Copies are combined within tasks before
    the shuffle, so that a payload that a third of all pages share moves once from each task."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    once = own.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1")).write.parquet(f"{path}/payloads")
    rows = own.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = rows.withColumn("_shared", F.col("payload_bytes") >= LEAST)
    owners = rows.where("_shared").groupBy("sha256").agg(F.max("page_id").alias("_owner")).withColumnRenamed("sha256", "_sha256")
    rows = rows.join(owners, F.col("_shared") & (F.col("sha256") == F.col("_sha256")), "left")
    revisit = F.col("_shared") & (F.coalesce(F.col("page_id") != F.col("_owner"), F.col("_owner").isNotNull()))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_owner")))
    rows.select("page_id", "sha256", headers_of(rows, date).alias("headers"), "refers_to").write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, payload_bytes and sha1 of each payload; reading the bytes of one whose digest differs is an error. Without
    payload, no bytes are read."""
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))).cast("binary")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong)
    return spark.read.parquet(f"{path}/payloads").select("sha256", checked.alias("payload"), "payload_bytes", "sha1")


def field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, headers, the fields of its headers, payload, payload_bytes, sha1, and record (its
    exact bytes). Columns that aren't asked for aren't moved. Only responses meet payloads for their records; a revisit has none
    in its record, so those of a page that very many share move no bytes, unless payload is asked for."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), read_payloads(spark, path)
    rows = heads.where("refers_to is null").join(payloads, "sha256").withColumn("body", F.col("payload"))
    rows = rows.unionByName(heads.where("refers_to is not null").join(payloads, "sha256").withColumn("body", F.lit(b"")))
    text = F.regexp_extract(F.decode("headers", "UTF-8"), r"(?s)^(.*?\r\n)\r\n", 1)
    kind = field(text, "WARC-Type")
    said = F.regexp_replace(field(text, "WARC-Payload-Digest"), "^sha1:", "")
    wrong = F.raise_error(F.lit("a record's digest differs from its payload's")).cast("string")
    return rows.select(
        "page_id",
        "headers",
        kind.alias("record_type"),
        field(text, "WARC-Target-URI").alias("url"),
        field(text, "WARC-Record-ID").alias("record_id"),
        F.nullif(field(text, "WARC-Refers-To"), F.lit("")).alias("refers_to_id"),
        "refers_to",
        "payload",
        "payload_bytes",
        F.when(said == F.col("sha1"), F.col("sha1")).otherwise(wrong).alias("payload_digest"),
        F.concat("headers", "body", F.lit(b"\r\n\r\n")).alias("record"),
    )


def parsed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of an archive (page_id, record), from
    the record's bytes; page_id alone comes from the archive, as its URN can't be turned back. A revisit has the payload and
    the page of the response that its WARC-Refers-To names, found by a join on the record id. A wrong Content-Length or
    digest is an error, and so are a record under another page's URN and a revisit of a record that isn't there."""
    fail = lambda said: F.raise_error(F.lit(said)).cast("string")
    # Latin-1 has a character for each byte, so that places in the text are places in the bytes
    chars = F.decode("record", "ISO-8859-1")
    rows = records.select("page_id", "record", (F.instr(chars, END + END) + len(END)).alias("_at"))
    rows = rows.withColumn("_head", F.decode(F.expr("substring(record, 1, _at - 1)"), "UTF-8"))
    block = F.expr(f"substring(record, _at + {len(END)})")
    said = field(F.col("_head"), "Content-Length").cast("long")
    rows = rows.select("page_id", "_head", block.alias("_rest"), said.alias("_n"))
    whole = (F.octet_length("_rest") == F.col("_n") + 2 * len(END)) & (F.expr("substring(_rest, cast(_n + 1 as int))") == F.lit((END + END).encode()))
    own = field(F.col("_head"), "WARC-Record-ID")
    own = F.when(~F.coalesce(whole, F.lit(False)), fail("a record's block differs from its Content-Length")).when(own != record_id(F.col("page_id")), fail("a record's id isn't its page's")).otherwise(own)
    rows = rows.select("page_id", "_head", own.alias("_id"), F.expr("substring(_rest, 1, cast(_n as int))").alias("_block"))
    http = F.instr(F.decode("_block", "ISO-8859-1"), END + END) + 2 * len(END) - 1
    rows = rows.withColumn("_http", http)
    length = field(F.decode(F.expr("substring(_block, 1, _http)"), "ISO-8859-1"), "Content-Length").cast("long")
    rows = rows.select(
        "page_id",
        "_id",
        field(F.col("_head"), "WARC-Type").alias("record_type"),
        F.nullif(field(F.col("_head"), "WARC-Refers-To"), F.lit("")).alias("_to"),
        F.regexp_replace(field(F.col("_head"), "WARC-Payload-Digest"), "^sha1:", "").alias("_said"),
        length.alias("_length"),
        F.expr("substring(_block, _http + 1)").alias("_payload"),
    )
    rows = rows.select("page_id", "_id", "record_type", "_to", "_said", "_length", F.octet_length("_payload").cast("long").alias("_bytes"), F.sha1("_payload").alias("_sha1"))
    response = F.col("record_type") == "response"
    right = (F.col("_bytes") == F.when(response, F.col("_length")).otherwise(0)) & (~response | (F.col("_sha1") == F.col("_said")))
    rows = rows.withColumn("_said", F.when(F.coalesce(right, F.lit(False)), F.col("_said")).otherwise(fail("a record's payload differs from its headers")))
    rows = settled(rows.drop("_sha1"))
    named = rows.where(F.col("_to").isNotNull()).select(F.col("_to").alias("_there")).distinct()
    there = rows.where(response).join(named, F.col("_id") == F.col("_there"), "left_semi").groupBy("_id", "_said", "_bytes").agg(F.min("page_id").alias("_page"))
    there = there.select(F.col("_id").alias("_there"), F.col("_said").alias("_digest"), F.col("_bytes").alias("_whole"), "_page")
    found = rows.join(there, (F.col("_to") == F.col("_there")) & (F.col("_said") == F.col("_digest")) & (F.col("_length") == F.col("_whole")), "left")
    lost = ~response & F.col("_there").isNull()
    return found.select("page_id", F.col("_length").alias("payload_bytes"), F.when(lost, fail("a revisit's response isn't there")).otherwise(F.col("_said")).alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages to a new place in the shared folder and reads it back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
