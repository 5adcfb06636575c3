"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds each distinct payload once,
under its SHA-256. ``records`` holds one row per record with its exact header bytes (the
WARC fields and the HTTP head) and the digest of its payload. Reading joins the two,
verifies each payload against both digests and its length, and can rebuild the bytes of
every original record.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the
smallest page id is a response and the others are revisits that refer to it; smaller ones
are all responses. Defined results: a null payload counts as empty; a null url leaves the
target out of the header; rows that repeat the smallest page id with the same payload are
responses too; a null page id comes after all others. Extra columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: RFC 4648 base32 digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The WARC/1.1 revisit profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five hex digits make four base32 digits."""
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def header(kind: Column, page: Column, refers_to: Column, url: Column, sha1: Column, n_bytes: Column,
           date: str) -> Column:
    """Exact bytes before the payload: WARC fields, blank line, HTTP head, blank line."""
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    n_bytes.cast("string"), F.lit(END + END))
    block = F.octet_length(head) + F.when(kind == "response", n_bytes).otherwise(F.lit(0))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = F.concat_ws(
        END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page)), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe), F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")))
    return F.encode(F.concat(fields, F.lit(END + END), head), "UTF-8")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write the archive of all rows to ``path``.

    Payloads are grouped by digest with a map-side step, so each map task sends a payload
    once however many copies it has. Headers then meet the small columns of the stored
    payloads in a plain equi-join, whose skewed partitions Spark can split.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    (rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.first("payload").alias("payload"))
     .write.parquet(f"{path}/payloads"))
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"),
                       base32_of_hex(F.sha1("payload")).alias("sha1"))
    again = (F.col("n_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    made = slim.join(stored, "digest").select(
        "page_id", "digest",
        header(kind, F.col("page_id"), F.col("first_id"), F.col("url"), F.col("sha1"), F.col("n_bytes"),
               date).alias("header"))
    made.write.parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, digest), from the archive alone.

    Types, references and digests are parsed from the stored headers. Each stored payload
    is hashed again; a mismatch with its key, or with a header's digest or length, fails the job.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    stored = stored.select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("sha1"),
        (F.sha2("payload", 256) == F.col("digest")).alias("sound"))
    text = F.decode("header", "UTF-8")
    field = lambda name, form: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {form}\r\n", 1), F.lit(""))
    records = spark.read.parquet(f"{path}/records").select(
        "page_id", "digest", field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        F.regexp_extract(text, r"(?s)\r\n\r\nHTTP.*\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("said_bytes"))
    good = F.col("sound") & (F.col("sha1") == F.col("payload_digest")) & (F.col("said_bytes") == F.col("payload_bytes"))
    joined = records.join(stored, "digest", "left")
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest"))).cast("long"))
    return joined.select("page_id", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
                         checked.alias("payload_bytes"), "payload_digest", "digest")


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the bytes of each original record, rebuilt by joining headers and payloads."""
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    records = spark.read.parquet(f"{path}/records")
    response = F.decode("header", "UTF-8").contains(f"{END}WARC-Type: response{END}")
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    return records.join(stored, "digest").select(
        "page_id", F.concat(F.col("header"), body, F.lit((END + END).encode())).alias("record"))
