"""WARC derivatives: metadata and plain-text conversion records from responses.

Records are rows. A response row has its named header fields and its block (HTTP header
and body); each response yields a metadata record and, where its body is HTML or plain
text, a conversion record. Both refer to the response by its identifier and keep its
target, date and digests. Identifiers are name-based, so a lost task that runs again makes
the same records. Only the text extraction runs in Python.
"""

from __future__ import annotations

import base64
import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelmill.functions.text import bind
from labelmill.llm.html_text import main_text_column
from labelmill.llm.steps import bounded_batches

VERSION = "WARC/1.1"
#: Header fields of a record, in the order in which they are written.
FIELDS = {
    "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date",
    "WARC-Refers-To-Target-URI": "refers_to_target_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest",
    "Content-Type": "content_type", "Content-Length": "content_length",
}
COLUMNS = list(FIELDS.values())


def record_id(*parts: Column) -> Column:
    """A urn:uuid of version 5 form made from the SHA-1 of the parts."""

    def uuid(h: Column) -> Column:
        variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
        cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-"), variant, cut[3], F.lit("-"), cut[4], F.lit(">"))

    return bind(F.sha1(F.concat_ws("\n", *parts)), uuid)


# The digits of base 32 as numbers are written, and as digests are.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(data: Column) -> Column:
    """sha1:<base32>: 20 bits make five hexadecimal or four base-32 digits."""

    def base32(h: Column) -> Column:
        return F.concat(*[F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)])

    return F.concat(F.lit("sha1:"), F.translate(bind(F.sha1(data), base32), _DIGITS, _BASE32))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id") -> DataFrame:
    """Response records of a page table (key, url, html); null html is an empty body."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    out = pages.select(F.col(key).alias("source_key"), F.col("url").cast("string").alias("target_uri"), F.encode(head, "UTF-8").alias("_head"), body.alias("_body"))
    out = out.withColumn("block", F.concat("_head", "_body"))
    key_text = F.coalesce(F.col("source_key").cast("string"), F.lit(""))
    return out.select(
        "source_key", F.lit("response").alias("warc_type"), record_id(F.lit("response"), key_text, F.coalesce("target_uri", F.lit("")), F.sha1("block")).alias("record_id"), "target_uri",
        F.lit(date).alias("warc_date"), digest(F.col("_body")).alias("payload_digest"), digest(F.col("block")).alias("block_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def split_http(block: Column) -> tuple[Column, Column]:
    """(HTTP header, body) of a response block as text with a character per byte, whatever its
    encoding; without an empty line all is body."""
    text = F.decode(block, "ISO-8859-1")
    at = F.locate("\r\n\r\n", text)
    return F.when(at > 0, F.substring(text, F.lit(1), at + 1)).otherwise(""), F.when(at > 0, F.substring(text, at + 4, F.length(text))).otherwise(text)


@F.pandas_udf(T.StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes (a character each) read in the named encoding, or UTF-8 if there is no such."""

    def one(text, name):
        if text is None:
            return None
        try:
            return text.encode("latin-1").decode(codecs.lookup((name or "utf-8").strip("\"' ")).name, "replace")
        except (LookupError, UnicodeError, ValueError, TypeError):
            return text.encode("latin-1").decode("utf-8", "replace")

    return pd.Series([one(t, n) for t, n in zip(body, charset)], dtype=object)


def _header(head: Column, pattern: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(head, r"(?im)^content-type:[ \t]*" + pattern, 1)), F.lit(""))


def body_text(head: Column, body: Column) -> tuple[Column, Column]:
    """(kind, text) of a body: html, plain or null for other media types; a response without a
    type is taken for HTML. UTF-8 stays in the JVM, other character sets are read in Python."""
    media, charset = F.trim(_header(head, r"([^;\r\n]+)")), _header(head, r"[^\r\n]*;[ \t]*charset=([^;\s]+)")
    kind = F.when(media.isNull() | media.isin("text/html", "application/xhtml+xml"), "html").when(media == "text/plain", "plain")
    usual = F.coalesce(F.translate(charset, "\"'", ""), F.lit("utf-8")).isin("utf-8", "utf8", "us-ascii")
    known = F.when(usual, F.try_validate_utf8(F.encode(body, "ISO-8859-1").cast("string")))
    return kind, F.coalesce(known, _decoded(F.when(kind.isNotNull() & known.isNull(), body), charset))


def derivatives(responses: DataFrame, software: str = "labelmill") -> DataFrame:
    """A metadata record for every response, and a conversion record where its body is HTML or
    plain text.

    The metadata record is application/warc-fields: source headers, status, digests, length
    and the identifier of the conversion record. The conversion record is the main text of
    HTML, or plain text as it is, as UTF-8 (empty text: no bytes). Bodies are read in the
    character set that the header names, with a replacement character for bytes that have no
    meaning there. A null block is an empty response without a type. Repeated responses yield repeated records; null fields are
    left out of the headers. Columns that are no record fields are dropped.
    """
    head, body = split_http(F.coalesce("block", F.lit(b"")))
    src = bounded_batches(responses).withColumns({"_head": head, "_body": body})
    kind, text = body_text(F.col("_head"), F.col("_body"))
    src = src.withColumns({"_kind": kind, "_plain": text})
    src = src.withColumn("_text", F.when(F.col("_kind") == "plain", F.col("_plain")).otherwise(main_text_column(F.when(F.col("_kind") == "html", F.col("_plain")))))
    src = src.withColumns({
        "_conv": record_id(F.lit("conversion"), F.col("record_id")), "_meta": record_id(F.lit("metadata"), F.col("record_id")), "_data": F.encode(F.coalesce("_text", F.lit("")), "UTF-8"),
    })
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    fields = F.concat(
        line("software", F.lit(software)), line("http-status", F.nullif(F.regexp_extract("_head", r"^HTTP/\S+ (\d+)", 1), F.lit(""))),
        line("source-content-type", F.col("content_type")), line("source-content-length", F.col("content_length")), line("source-payload-digest", F.col("payload_digest")),
        line("source-block-digest", F.col("block_digest")), line("conversion-record-id", F.when(F.col("_kind").isNotNull(), F.col("_conv"))),
        F.regexp_replace(F.regexp_replace("_head", r"^HTTP/[^\r\n]*\r\n", ""), r"(?m)^(?=[^\r\n])", "source-http-"),
    )
    meta = F.encode(fields, "UTF-8")

    def record(kind: str, own_id: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), F.col(own_id).alias("record_id"), F.col("record_id").alias("refers_to"), F.col("target_uri"), F.col("warc_date"), F.col("target_uri").alias("refers_to_target_uri"),
            F.col("warc_date").alias("refers_to_date"), digest(block).alias("payload_digest"), digest(block).alias("block_digest"), F.lit(content_type).alias("content_type"),
            F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
        )

    src = src.withColumn("_fields", meta)
    both = F.array(record("metadata", "_meta", "application/warc-fields", F.col("_fields")), record("conversion", "_conv", "text/plain; charset=utf-8", F.col("_data")))
    keep = ["source_key"] if "source_key" in responses.columns else []
    made = F.filter(both, lambda r: (r["warc_type"] == "metadata") | F.col("_kind").isNotNull())
    return src.select(*keep, F.explode(made).alias("r")).select(*keep, "r.*")


def serialized(records: DataFrame) -> Column:
    """The bytes of each record as they stand in a WARC file."""
    have = [(name, c) for name, c in FIELDS.items() if c in records.columns]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("") for name, c in have]
    head = F.encode(F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("\r\n")), "UTF-8")
    return F.concat(head, F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8"))


_HEAD = re.compile(rb"WARC/\d\.\d\r\n")


def parse_records(data: bytes) -> list[dict]:
    """Records of a run of bytes, by their Content-Length. A record that is cut short, and one
    without a length, ends the run."""
    out, at = [], 0
    by_name = {k.lower(): v for k, v in FIELDS.items()}
    while m := _HEAD.match(data, at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        lines = data[m.end() : end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
        length = fields.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            break
        size = int(length)
        row = dict.fromkeys(COLUMNS) | {by_name[k]: v for k, v in fields.items() if k in by_name}
        out.append(row | {"content_length": size, "block": data[end + 4 : end + 4 + size]})
        at = end + 4 + size + 4
    return out


def read_records(chunks: DataFrame, column: str = "data") -> DataFrame:
    """Records of a table whose rows hold whole records as bytes."""
    schema = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in COLUMNS) + ", block binary"

    def run(batches):
        for pdf in batches:
            rows = [r for data in pdf[column] if data is not None for r in parse_records(bytes(data))]
            yield pd.DataFrame(rows, columns=[*COLUMNS, "block"])

    return chunks.select(column).mapInPandas(run, schema)


def python_digest(data: bytes) -> str:
    import hashlib

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
