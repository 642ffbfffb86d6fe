"""A content-addressed WARC archive: record headers and payloads in two tables.

``payloads`` holds every distinct payload once, under its SHA-256; ``records`` holds the
exact header bytes of every record and the address of its payload. A record as it stands
in a WARC file is the header followed by the payload of its address, joined back on
reading, where payload lengths and digests are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import settle, utf8
from tidegrid.session import scratch_path

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
LEAST_SHARED = 1000  # bytes from which equal payloads are stored as revisits


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line breaks cannot occur in a header."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def described(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> tuple[DataFrame, DataFrame]:
    """The facts of every record, and the leading record of each payload that occurs again."""
    payload = utf8(body_col)
    facts = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumns(
        {
            "address": F.sha2("payload", 256),
            "sha1": F.sha1("payload"),
            "bytes": F.octet_length("payload").cast("long"),
        }
    )
    # Which record of equal payloads is the response; narrow rows, combined before the shuffle.
    leading = (
        facts.filter(F.col("bytes") >= LEAST_SHARED)
        .groupBy(F.col("address").alias("shared"))
        .agg(
            F.count("*").alias("n"),
            F.max("page_id").alias("first_id"),
            F.min("sha1").alias("low"),
            F.max("sha1").alias("high"),
        )
        .filter("n > 1")
    )
    return facts, leading


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = RECORD_DATE,
) -> str:
    """Writes the archive of ``pages`` under ``path``: the tables ``records`` and ``payloads``.

    Of records with equal payloads of at least 1000 bytes the one with the largest id is the
    response and the others revisit it; smaller payloads are all responses, stored once each.
    Equal addresses are checked against a second digest and a collision is an error.

    A null body is an empty payload; a null url leaves its header line out. Records of one id
    and payload are one record repeated: all of them are the response. A null id is the
    smallest; if all ids of a payload are null, all its records are responses. An empty
    table gives an empty archive. Extra columns are not archived.
    """
    facts, leading = described(pages, id_col, url_col, body_col)
    clash = F.raise_error(F.concat(F.lit("payloads differ under one address: "), F.col("shared")))
    leading = leading.filter(F.when(F.col("low") != F.col("high"), clash.cast("boolean")).otherwise(True))
    leading = settle(leading.select("shared", "first_id"), "warc-shared")
    narrow = facts.drop("payload")
    joined = narrow.join(leading, F.col("address") == F.col("shared"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    block = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("bytes") + len(HTTP_HEAD))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Refers-To", record_id(F.col("first_id")))).otherwise(""),
        F.when(revisit, _line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit("\r\n"),
        F.lit(HTTP_HEAD),
    )
    joined.select(F.encode(header, "UTF-8").alias("header"), "address").write.mode(
        "errorifexists"
    ).parquet(f"{path}/records")
    # One row per address; of a shared payload the leading record carries it, so that
    # copies do not travel. Small payloads are few bytes each.
    carried = facts.join(leading, F.col("address") == F.col("shared"), "left").filter(
        F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    carried.select("address", "payload").dropDuplicates(["address"]).write.mode(
        "errorifexists"
    ).parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archived records: record (all its bytes), payload and the fields of its header.

    A payload whose length or digest is not what its address says is an error. Revisits hold
    no payload of their own; ``payload`` is that of the record they refer to.
    """
    records = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads").withColumnRenamed("address", "stored_at")
    found = F.sha2("payload", 256)
    broken = F.raise_error(F.concat(F.lit("payload does not match its address: "), F.col("stored_at")))
    stored = stored.withColumn(
        "payload", F.when(found == F.col("stored_at"), F.col("payload")).otherwise(broken.cast("binary"))
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    joined = records.join(stored, F.col("address") == F.col("stored_at"), "left")
    text = F.decode("header", "UTF-8")

    def field(name: str, pattern: str = "[^\r]*") -> Column:
        found_ = F.regexp_extract(text, f"(?:^|\r\n){name}: ({pattern})\r\n", 1)
        return F.when(found_ != "", found_)

    page = F.regexp_extract(F.coalesce(field("WARC-Record-ID"), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    refers = F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    kind = field("WARC-Type")
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        kind.alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
        F.concat(F.col("header"), body, F.lit(END.encode())).alias("record"),
        "payload",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
    )


def fresh_archive(spark: SparkSession) -> str:
    """A new folder in the shared scratch space."""
    return scratch_path(spark, "warc")
