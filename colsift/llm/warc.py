"""WARC archives: written in page order, rolled by compressed size, committed by manifest, and read back."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.llm.files import Rolling, content, opened
from colsift.llm.staging import shared_folder, staged
from colsift.llm.words import slices

FILE_BYTES = 64 << 20
REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def planned(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Each page, and beside it a mark (``page`` false, no html) if it is a revisit: of equal payloads of ``least`` bytes or more, the
    largest page_id is the response.

    Only digests are grouped, after partial maxima, so a payload with a third of all pages is a row a task. Marks meet their pages
    in the writer's order, so that html is shuffled once, for that order.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"),
                        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"), F.col("url").cast("string").alias("url"), html.alias("html"))
    heads = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count("*").alias("copies"))
    # Written first, so that the join is of two plain exchanges, of which Spark can split a payload that many pages share.
    heads = staged(heads.where("copies > 1").drop("copies"), "heads")
    again = ~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull()
    marks = rows.select("page_id", "payload_digest").join(heads, "payload_digest").where(again).distinct()
    none = F.lit(None).cast("string")
    marks = marks.select("page_id", "payload_digest", F.lit(False).alias("page"), F.col("head").alias("refers_to"), none.alias("url"), none.alias("html"))
    return marks.unionByName(rows.select("page_id", "payload_digest", F.lit(True).alias("page"), F.lit(None).cast("long").alias("refers_to"), "url", "html"))


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(row: dict) -> bytes:
    """One record with headers and digests made anew; a revisit holds the HTTP headers only."""
    payload = row["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if row["record_type"] == "response" else http
    url = quote(row["url"] or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_name(row['page_id'])}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
            f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(row['refers_to'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages to ``folder``, range-sorted by page_id; returns the manifest (part, seq, file, n_records, n_bytes).

    Each record is a gzip member without a time stamp, so equal input gives equal archives. A task rolls its file once
    that has ``file_bytes`` compressed bytes. Null ids come first. A null payload is empty, a null URL is ``about:blank``.
    Repeated rows are records of their own; of those with the page_id of a response, each with its payload is a response. An empty
    table has no files. Columns other than page_id, url and html are ignored, whatever their names.
    """
    opened(folder)  # fails here rather than in every task

    def write(batches):
        part, seq, out, n = TaskContext.get().partitionId(), 0, None, 0
        marked = head = None

        def closed():
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": out.commit(), "n_records": n, "n_bytes": out.size}],
                                              pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                own = row["page_id"], row["payload_digest"]
                if not row["page"]:
                    marked, head = own, row["refers_to"]
                    continue
                row["record_type"], row["refers_to"] = ("revisit", head) if own == marked else ("response", None)
                if out is None:
                    out, n = Rolling(folder, f"part-{part:06d}-{seq:06d}", ".warc.gz"), 0
                    out.write(gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_name(None)}\r\nWARC-Date: {DATE}\r\n"
                                            "Content-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC 1.1\r\n\r\n\r\n".encode(), mtime=0))
                out.write(gzip.compress(record(row), mtime=0))
                n += 1
                if out.size >= file_bytes:
                    yield closed()
                    out, seq = None, seq + 1
        if out is not None:
            yield closed()

    order = F.col("page_id").asc_nulls_first(), F.col("payload_digest").asc()
    spread = planned(pages, least).repartitionByRange(*order).sortWithinPartitions(*order, "page", "url")
    return staged(spread.mapInArrow(write, "part int, seq int, file string, n_records long, n_bytes long"), "manifest")


def records(stream):
    """Header fields and block of each record of an archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as text:
        while line := text.readline():
            if not line.strip():
                continue
            fields = {}
            while (line := text.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            yield fields, text.read(int(fields["content-length"]))


def parsed(fields: dict, block: bytes) -> dict:
    """The row a record stands for; digests are checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if hashlib.sha1(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {fields['warc-record-id']}")
    number = lambda name: int(fields[name]) if name in fields else None
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    html = payload.decode() if fields["warc-type"] == "response" else None
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"), "url": fields["warc-target-uri"], "html": html}


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in ``manifest`` (ROW; html is null for revisits), a task an archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with content(folder, name) as stream:
                    for fields, block in records(stream):
                        if fields["warc-type"] != "warcinfo":
                            held.append(parsed(fields, block))
                            size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(list(zip(names, kinds))))
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, pa.schema(list(zip(names, kinds))))

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, ROW)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages in a new folder of the shared one and read them back."""
    folder = shared_folder(pages.sparkSession)
    return read_warc(pages.sparkSession, write_warc(pages, folder), folder)
