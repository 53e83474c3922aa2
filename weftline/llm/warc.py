"""WARC archives with resolved revisits: write deduplicated records with fresh headers, read them back, resolve revisits by payload digest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf

#: Characters of a payload in one archive file, about; a reader holds one file at a time.
FILE_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
#: Digests of several pages broadcast at most, about 100 bytes each; beyond, the same join is shuffled.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_sha1(c: Column) -> Column:
    """SHA-1 in RFC 4648 base 32: 5 hexadecimal digits are 4 characters."""
    h = F.sha1(c)
    four = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(c: Column, digest: Column) -> Column:
    """A urn:uuid that the id and the payload's digest fix."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(c.cast("string"), F.lit("null")), F.lit(" "), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, where: str, least: int = 0, date: str = DATE) -> None:
    """One record per row of pages (page_id, url, html) into gzip files under where; date is their WARC-Date.

    Of records with equal payloads of at least least bytes, that with the smallest page_id is a response and the
    others are revisits without payload; smaller payloads are all responses. Headers alone are shuffled, by payload
    digest; the digests that several pages share go to all tasks while there are at most BROADCAST_DIGESTS of them, so
    that payloads stay where they were read, and beyond that meet the pages in a join, which can split a digest that
    very many pages share. An empty table gives no records. Null html is an empty payload,
    null url an empty target; line ends in a url become spaces. Rows that repeat page_id and payload are responses each,
    and so are pages of null page_id whose payload no page with an id has.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    shelf = Shelf(pages.sparkSession, "digests")
    shared = shelf.put(p.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "shared")
    mean = pages.agg(F.avg(F.length("html"))).first()[0] or 0
    p = p.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "digest", "left")
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id")), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "html"))
    p = p.withColumn("http", http).withColumn("block", block)
    record = F.concat(head, F.octet_length("block"), F.lit(END), F.col("block"))
    # the line separator of the text writer is the end of a record
    rows = max(1, int(FILE_BYTES / max(mean, 1)))
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(where)


_head = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


def _records(data: bytes):
    """(headers, HTTP headers, payload) of every record of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {k.lower(): v for k, v in _head.findall(data, data.index(b"\r\n", at) + 2, end + 2)}
        n = int(head[b"content-length"])
        block = data[end + 4 : end + 4 + n]
        cut = block.index(b"\r\n\r\n")
        yield head, block[: cut + 2], block[cut + 4 :]
        at = end + 4 + n + 4


def read_archives(spark: SparkSession, where: str, payloads: bool = False) -> DataFrame:
    """The records under where: page_id, url, record_id, record_type, payload_digest, refers_to_id, payload_bytes, intact and payload (null unless asked for).

    payload_bytes is what the record itself holds (0 for revisits); intact tells whether a response's payload has its digest.
    """

    def run(batches):
        kind = ["page_id", "url", "record_id", "record_type", "payload_digest", "refers_to_id", "payload_bytes", "intact", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                rows, held = [], 0
                for h, _, payload in _records(gzip.GzipFile(fileobj=io.BytesIO(data)).read() if name.endswith(".gz") else data):
                    get = lambda k, h=h: h[k].decode() if k in h else None
                    digest = get(b"warc-payload-digest").removeprefix("sha1:")
                    fits = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if h[b"warc-type"] == b"response" else None
                    rows.append((int(h[b"x-page-id"]) if b"x-page-id" in h else None, get(b"warc-target-uri"), get(b"warc-record-id"), get(b"warc-type"), digest, get(b"warc-refers-to"), len(payload), fits, payload if payloads else None))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], kind)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], kind)

    files = spark.read.format("binaryFile").load(where).select("path", "content")
    return files.mapInArrow(run, "page_id long, url string, record_id string, record_type string, payload_digest string, refers_to_id string, payload_bytes long, intact boolean, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records as read_archives gives them: each with refers_to, the page_id of the response a revisit stands for, and that response's payload_bytes.

    Headers are shuffled by payload digest; responses are grouped first, one row a digest, and the join with revisits
    of a hot digest can be split. A revisit without its response keeps null for both.
    """
    r = records.drop("payload")
    responses = r.filter("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.max("payload_bytes").alias("full"))
    out = r.join(responses, "payload_digest", "left")
    revisit = F.col("record_type") == "revisit"
    return out.withColumn("refers_to", F.when(revisit, F.col("original"))).withColumn("payload_bytes", F.when(revisit, F.col("full")).otherwise(F.col("payload_bytes"))).drop("original", "full")
