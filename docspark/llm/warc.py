"""WARC archives: a writer, and a sequential reader.

Each record is a gzip member of its own. The reader decompresses a member
incrementally, takes the block by its content length, checks the digests of block
and payload, if there are any, and goes on with the bytes behind the member. It holds one
record. It reads archives of others, too: all types of records, WARC/1.0 and 1.1, folded
headers, digests in base32 or hex by any algorithm that Python has. The payload is what
follows the HTTP header of an ``application/http`` block, and else the block.

Record ids are ``<urn:page:ID#PART-NUMBER>``, so no two are the same; a revisit refers to
``<urn:page:ID>``. It also says in a header of its own how long the payload is that it
leaves out, because WARC has no field for that.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, that with the largest
id is written as a response and the others as revisits, which have HTTP headers but
no payload and refer to the response. Payloads are equal if SHA-1 and length are.

Defined results: null html is an empty payload, so a response; a null url leaves out
the target header; a null id is written as ``null`` and read as null, and is a
response only if no copy has an id; rows that share the largest id are all responses;
an empty table gives no archive and an empty result. Other columns are not archived.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import attach_class, pieces, qualified, settle, work_dir
from docspark.llm.files import create, new_name, open_stream

MIN_REVISIT = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 16


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def header_value(x: str) -> str:
    """Without the control characters that would end a header."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in x)


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, number: str = "0", date: str | None = None) -> bytes:
    """One gzip member. ``digest``: SHA-1 of the payload in hex; ``number``: what tells this record from others of the page."""
    block = HTTP + (payload if kind == "response" else b"")
    ident = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{ident}#{number}>",
        f"WARC-Date: {date or now()}",
        f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {sha1_label(bytes.fromhex(digest))}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """An archive whose framing or digests don't hold."""


_page_uri = re.compile(r"<?urn:page:(-?\d+)(?:#[^>]*)?>?").fullmatch


def _page(x: str | None) -> int | None:
    """The page of a record id; None for ids of others."""
    found = _page_uri(x or "")
    return int(found[1]) if found else None


def digest_hex(label: str | None) -> tuple[str, str] | None:
    """Algorithm and digest in hex of ``algorithm:digest``; None for one that can't be checked."""
    name, _, value = (label or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return None
    size = hashlib.new(name).digest_size
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def header_fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields, by names in lower case. A line that begins with a blank goes on with the one before."""
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return first.strip(), fields


def read_records(stream) -> Iterator[dict]:
    """Records of an archive, in order. ``stream``: anything with read(n).

    payload_digest is SHA-1 in hex, as the record says it or as counted; payload_bytes is null for a revisit that doesn't say it.
    """
    left, offset = b"", 0
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        unpack, data, taken = zlib.decompressobj(31), bytearray(), 0
        length = start = None
        while not unpack.eof:
            left = left or stream.read(CHUNK)
            if not left:
                raise Damaged(f"the member at {offset} ends early")
            data += unpack.decompress(left)
            taken += len(left) - len(unpack.unused_data)
            left = unpack.unused_data
            if start is None and (end := data.find(b"\r\n\r\n")) >= 0:
                start = end + 4
                first, fields = header_fields(bytes(data[:end]))
                if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
                    raise Damaged(f"the member at {offset} has no WARC header")
                length = int(fields["content-length"])
        if start is None or len(data) != start + length + 4 or data[-4:] != b"\r\n\r\n":
            raise Damaged(f"the member at {offset} isn't as long as its header says")
        block = bytes(data[start : start + length])
        said = digest_hex(fields.get("warc-block-digest"))
        if said and hashlib.new(said[0], block).hexdigest() != said[1]:
            raise Damaged(f"the block at {offset} has another digest")
        kind = fields.get("warc-type", "").lower()
        http = fields.get("content-type", "").lower().startswith("application/http")
        payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else b"" if http else block
        said, size = digest_hex(fields.get("warc-payload-digest")), fields.get("x-payload-length", "")
        # A revisit may leave the payload out, and a segment has part of it.
        whole = kind != "revisit" and "warc-segment-number" not in fields
        if whole and (said and hashlib.new(said[0], payload).hexdigest() != said[1] or size and size != str(len(payload))):
            raise Damaged(f"the payload at {offset} has another digest")
        sha1 = said[1] if said and said[0] == "sha1" else hashlib.sha1(payload).hexdigest() if whole else None
        yield {
            "record_id": fields.get("warc-record-id"), "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "date": fields.get("warc-date"), "payload": payload, "payload_bytes": len(payload) if whole else int(size) if size.isdigit() else None,
            "payload_digest": sha1, "offset": offset, "refers_to": _page(fields.get("warc-refers-to")),
        }
        offset += taken


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("__key", F.concat_ws(":", "payload_digest", F.octet_length("payload")))
    narrow = rows.select("__key", "page_id", F.octet_length("payload").alias("n"))
    classes = narrow.where(F.col("n") >= MIN_REVISIT).groupBy("__key").agg(F.max("page_id").alias("__top"), F.count(F.lit(1)).alias("__rows"))
    classes = settle(classes.where((F.col("__rows") > 1) & F.col("__top").isNotNull()), "warc-classes")
    rows = attach_class(rows, classes, "__key", "__rows", F.xxhash64("page_id"))
    revisit = F.col("__top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__top"))
    return rows.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__top")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes an archive for each partition; a settled table of (path, records)."""
    rows = classified(pages, **columns)
    folder, date = qualified(pages.sparkSession, folder) if folder else work_dir(pages.sparkSession, "warc"), now()

    def archive(batches):
        path, out, n = new_name(folder, "warc.gz"), None, 0
        part = path.rpartition("/part-")[2].partition(".")[0]
        for b in pieces(batches, 50):
            for r in b.to_pylist():
                out = out or create(path)
                out.write(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], f"{part}-{n}", date))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return settle(rows.mapInArrow(archive, "path string, records long"), "warc-files")


def read(archives: DataFrame) -> DataFrame:
    """Records of the archives in the column ``path``; payloads are read and checked, but not returned."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, archive string, offset long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in schema.split(", "))])

    def records(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with open_stream(path) as stream:
                    for r in read_records(stream):
                        rows.append({k: r.get(k) for k in names} | {"archive": path})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=types)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    files = max(1, archives.count())
    return archives.select("path").repartition(files).mapInArrow(records, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    out = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q
"""
