"""Content-addressed WARC archive.

The archive is two tables.  ``payloads`` holds every distinct payload once under its
SHA-256; ``headers`` holds the exact header block of every record with the digest it
refers to.  Records are put together again by a join on the digest.  A digest is
verified twice: rows that meet under one SHA-256 on writing must agree in length and
SHA-1, and on reading the stored bytes are hashed again; a mismatch is an error.

Defined cases: a null payload is empty; equal payloads of any size, empty ones too,
share one response, the record with the largest id (a null id counts as smallest);
rows that repeat an id and its payload are all of the same type; a null id is written
as ``none``; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The RFC 4648 alphabet and the WARC 1.1 revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hex string whose length is a multiple of five (a SHA-1 has 40)."""
    letters = []
    for at in range(0, 40, 5):
        word = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(BASE32), F.shiftright(word, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _http_head(size: Column) -> Column:
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        size.cast("string"), F.lit(EOL + EOL))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(kind: Column, date: str) -> Column:
    """Header block of one record, up to and with the empty line."""
    response = kind == "response"
    http = F.length(_http_head(F.col("_size")))
    url = F.regexp_replace(F.coalesce(F.col("_url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), kind, F.lit(f"{EOL}WARC-Record-ID: "), _urn(F.col("_id")),
        F.lit(f"{EOL}WARC-Target-URI: "), url, F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Payload-Digest: sha1:"),
        F.col("_sha1"),
        F.when(response, "").otherwise(F.concat(
            F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), _urn(F.col("_owner")))),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "),
        (http + F.when(response, F.col("_size")).otherwise(0)).cast("string"), F.lit(EOL + EOL))


def write_archive(
    pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write ``path/payloads`` and ``path/headers``.

    Copies of a payload are dropped before the shuffle by a partial aggregate, so a hot
    payload moves once per task.  Headers never carry payload bytes through a shuffle.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    facts = pages.select(
        F.col(record_id).alias("_id"), F.col(url).alias("_url"), F.sha2(body, 256).alias("_key"),
        base32_of_hex(F.sha1(body)).alias("_sha1"), F.octet_length(body).cast("long").alias("_size"))
    _store_payloads(pages.select(body.alias("payload")), f"{path}/payloads")
    owner = facts.groupBy("_key").agg(F.max("_id").alias("_owner"))
    known = facts.join(owner, "_key")
    kind = F.when(F.col("_id").eqNullSafe(F.col("_owner")), "response").otherwise("revisit")
    known.select(F.col("_key").alias("sha256"), _header(kind, date).alias("header")).write.parquet(f"{path}/headers")


def _store_payloads(bodies: DataFrame, path: str) -> None:
    keyed = bodies.select(
        F.sha2("payload", 256).alias("sha256"), "payload", F.sha1("payload").alias("_second"),
        F.octet_length("payload").alias("_size"))
    once = keyed.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.min("_second").alias("_a"), F.max("_second").alias("_b"),
        F.min("_size").alias("_m"), F.max("_size").alias("_n"))
    same = (F.col("_a") == F.col("_b")) & (F.col("_m") == F.col("_n"))
    verified = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share one SHA-256")))
    once.select("sha256", verified.alias("payload")).write.parquet(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with their facts, each hashed again against its key."""
    raw = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    return raw.select(
        "sha256", "payload",
        F.when(sound, base32_of_hex(F.sha1("payload"))).otherwise(
            F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record, put together by the join: id, type, payload facts and exact bytes.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, payload
    (the full payload, of revisits too), record (the bytes of the WARC record).  What is
    not selected is not shuffled.
    """
    heads = spark.read.schema("sha256 string, header string").parquet(f"{path}/headers")
    both = heads.join(read_payloads(spark, path), "sha256")
    kind = _field("WARC-Type")
    claimed = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)\r\n", 1)
    http = F.encode(_http_head(F.col("payload_bytes")), "UTF-8")
    block = F.when(kind == "response", F.concat(http, F.col("payload"))).otherwise(http)
    end = F.lit(EOL + EOL).cast("binary")
    return both.select(
        _page_of(_field("WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        F.when(claimed == F.col("payload_digest"), F.col("payload_digest")).otherwise(
            F.raise_error(F.lit("a header and its payload disagree"))).alias("payload_digest"),
        kind.alias("record_type"),
        _page_of(_field("WARC-Refers-To")).alias("refers_to"),
        "payload", F.concat(F.encode("header", "UTF-8"), block, end).alias("record"))
