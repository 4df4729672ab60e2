"""WARC derivative records: responses to metadata and plain-text conversions (operator 4).

Every response record gives two records that point back at it:

* ``conversion``: its text as ``text/plain``, with ``WARC-Refers-To`` the response's id,
  ``WARC-Refers-To-Target-URI`` / ``-Date`` and the digest of its own block;
* ``metadata``: ``application/warc-fields`` with the source's status line, HTTP headers and
  digests, title, language and outlinks, ``WARC-Refers-To`` the response and
  ``WARC-Concurrent-To`` the conversion.

Ids are version 5 style UUIDs of kind and source id, so that a repeated task makes the same
records.  Digests are SHA-1 in base 32.  ``write_warc`` puts records in ``.warc.gz`` files, one
gzip member each, ``read_warc`` reads them back.

The query writes its records as ``.warc.gz`` files and reports what it reads back from them.

Nulls and edges: a null or empty page is a response with an empty payload and gives an empty
conversion; a null url leaves ``WARC-Target-URI`` out, control characters and spaces in one are
percent-encoded, so that it can't break out of its header; repeated rows give repeated records with
equal ids; unclosed tags end with the text; an empty table gives no records; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm import common as C
from gridspark.llm.files import open_fs

DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "gridspark:warc")
_TAG = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BLOCK = re.compile(rf"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b{_TAG}/?>", re.I)
OTHER = re.compile(rf"<[a-z!/?]{_TAG}>", re.I)
TITLE = re.compile(rf"<title\b{_TAG}>(.*?)</title", re.S | re.I)
LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)
LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"[^\S\n]+")
CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")

RECORD = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, concurrent_to string, content_type string, block_digest string, payload_digest string, source_digest string, content_length long, record binary"


def safe_uri(url: str | None) -> str | None:
    """``url`` without white space and control characters (percent-encoded)."""
    return None if url is None else CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The page's text: hidden parts dropped, block elements on lines of their own, spaces collapsed."""
    text = html.unescape(OTHER.sub("", BLOCK.sub("\n", HIDDEN.sub(" ", page))))
    lines = (x.strip() for x in SPACES.sub(" ", text).split("\n"))
    return "\n".join(x for x in lines if x)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record; headers without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def http_message(payload: bytes, head: str | None = None) -> bytes:
    """The HTTP message of a payload under its own head (lines without the empty one) or a plain one."""
    if head is not None:
        return "\r\n".join(x for x in head.splitlines() if x.strip()).encode() + b"\r\n\r\n" + payload
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): page_id, url, record_id, warc_date and the HTTP message.

    For pages that come with their HTTP head or date (columns ``http_head``, ``fetched``) those are
    used, for others a plain 200 and ``date``.
    """
    schema = StructType([pages.schema["page_id"]]).add("url", "string").add("record_id", "string").add("warc_date", "string").add("block", "binary")
    head = F.col("http_head") if "http_head" in pages.columns else F.lit(None).cast("string")
    fetched = F.coalesce(F.col("fetched").cast("string"), F.lit(date)) if "fetched" in pages.columns else F.lit(date)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [safe_uri(u) for u in batch.column(1).to_pylist()]
            ids = [record_id("response", str(p), u or "") for p, u in zip(batch.column(0).to_pylist(), urls, strict=True)]
            blocks = [http_message(h or b"", head) for h, head in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(urls, pa.string()), pa.array(ids, pa.string()), batch.column(4), pa.array(blocks, pa.binary())], ["page_id", "url", "record_id", "warc_date", "block"])

    return pages.select("page_id", "url", "html", head.alias("head"), fetched.alias("fetched")).mapInArrow(make, schema)


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def derived(url: str | None, source: str, date: str, block: bytes) -> list[tuple]:
    """The conversion and the metadata record of one response, as rows of ``RECORD``."""
    head, _, payload = block.partition(b"\r\n\r\n")
    page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode()
    block_digest, payload_digest = digest(block), digest(payload)
    conversion, metadata = record_id("conversion", source), record_id("metadata", source)
    link = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    title = TITLE.search(page)
    lang = LANG.search(page)
    status, *fields = head.decode("latin-1").split("\r\n")
    lines = [f"source-status: {status}", *(f"source-header: {x}" for x in fields), f"source-block-digest: {block_digest}", f"source-payload-digest: {payload_digest}"]
    lines += [f"title: {one_line(title[1])}"] if title else []
    lines += [f"language: {lang[1]}"] if lang else []
    lines += [f"outlink: {one_line(a or b or c)}" for a, b, c in LINK.findall(page)]
    out = []
    for kind, own, other, content, body in (("conversion", conversion, None, "text/plain; charset=utf-8", text), ("metadata", metadata, conversion, "application/warc-fields", "".join(f"{x}\r\n" for x in lines).encode())):
        own_digest = digest(body)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), *link, ("WARC-Concurrent-To", other), ("Content-Type", content), ("WARC-Block-Digest", own_digest), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Block-Digest", block_digest)]
        out.append((kind, own, url, date, source, other, content, own_digest, payload_digest, block_digest, len(body), record(headers, body)))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows of ``RECORD`` (and page_id) for each response record."""
    schema = StructType([records.schema["page_id"]])
    for field in RECORD.split(", "):
        schema = schema.add(*field.split())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows, ids = [], part.column(0).to_pylist()
                for row in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    rows += derived(*row)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
                kinds = [pa.string()] * 10 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x in ids for _ in (0, 1)], part.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["page_id", *(x.split()[0] for x in RECORD.split(", "))])

    return records.select("page_id", "url", "record_id", "warc_date", "block").mapInArrow(make, schema)


def derivative_report(pages: DataFrame) -> DataFrame:
    """What the written files say about every derived record; its page is the one whose response it refers to."""
    spark, uri = pages.sparkSession, C.shared_path(pages.sparkSession, "warc")
    C.arrow_batches(spark)
    made = responses(pages)
    files = write_warc(derivatives(made), uri).collect()  # a row a file
    back = read_files(spark, uri, [r.file for r in files])
    source = made.select("page_id", F.col("record_id").alias("refers_to")).distinct()
    # both sides grow with the pages: never broadcast
    return back.hint("merge").join(source.hint("merge"), "refers_to").select("page_id", *back.columns)


READ = "warc_type string, record_id string, target_uri string, refers_to string, concurrent_to string, content_type string, content_length long, block_digest string, payload_digest string, source_digest string"


def read_files(spark: SparkSession, uri: str, names: list[str]) -> DataFrame:
    """The records of ``.warc.gz`` files below ``uri`` by their headers; a file is streamed member by member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_fs(f"{uri}/{name}")
                with fs.open_input_stream(path, compression=None) as f:
                    rows = []
                    for raw in members(f):
                        h, block = parse(raw)
                        own = digest(block)
                        if own != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: the block of {h['WARC-Record-ID']} doesn't have its digest")
                        rows.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Target-URI"), h["WARC-Refers-To"], h.get("WARC-Concurrent-To"), h["Content-Type"], len(block), own, h["WARC-Source-Payload-Digest"], h["WARC-Source-Block-Digest"]))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        fields = [x.split() for x in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return listed.mapInArrow(read, READ)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    held, raw, parts = zlib.decompressobj(31), b"", []
    while True:
        raw = raw or stream.read(1 << 20)
        if not raw:
            return
        parts.append(held.decompress(raw))
        raw = b""
        if held.eof:
            yield b"".join(parts)
            raw, held, parts = held.unused_data, zlib.decompressobj(31), []


def write_warc(records: DataFrame, uri: str) -> DataFrame:
    """Write the ``record`` bytes below ``uri``, a ``.warc.gz`` file per partition; returns (file, records).

    A repeated task writes its own file again under the same name.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    numbered = records.select(F.spark_partition_id().alias("part"), "record")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, "", 0
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs, base = open_fs(uri)
                    name = f"{base}/part-{part:05d}.warc.gz"
                    own = f"{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own, compression=None)
                out.write(gzip.compress(raw, 1, mtime=0))
                n += 1
        if out is not None:
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([n], pa.int64())], ["file", "records"])

    return numbered.mapInArrow(write, "file string, records long")


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of the bytes of a ``.warc.gz`` (or plain) file."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        size = int(re.search(rb"Content-Length: (\d+)", raw[at:end])[1])
        stop = end + 4 + size + 4
        yield parse(raw[at:stop])
        at = stop
