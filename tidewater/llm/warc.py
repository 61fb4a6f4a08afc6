"""WARC archives: records written as gzip members, and a splittable reader that needs no index.

`write` puts a record for each page into archives in the shared folder; a payload of at least `REVISIT` bytes that an earlier record holds becomes a
revisit. `read` deals byte ranges of the archives to tasks. A task searches its range for gzip magic, validates each candidate
by decoding its header, and owns the records that start inside, read to their end wherever that is.

Null html is an empty payload; a null url is written as `urn:unknown`. Of equal payloads the largest page_id is the response (rows that repeat
this id are all responses); with null ids only, all are. Empty tables give no archives and an empty result. Extra columns are ignored.
Archives of failed task attempts are never listed, so a lost executor leaves no record twice. The reader takes any gzip-per-record archive. Where a range begins inside a
record that itself holds whole WARC members (in a stored deflate block), the range takes them for records; they start before the end of a record of an earlier range, and go.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, slices, stored

REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RAW = "path string, start long, at long, next long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PAGE_URN = "urn:x-page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record: a response with its payload, or a revisit of another page's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:unknown"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    out, name, written, count = None, "", 0, 0
    done: list[tuple[str, int, int]] = []
    try:
        for batch in slices(batches, "html"):
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:  # a name of its own: attempts of one task never meet
                    name, written, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page_id, url, (html or "").encode(), digest, refers_to))
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", written, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", written, count))
            out = None
    finally:
        if out is not None:
            out.close()
    for row in done:
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), row, strict=True))], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The manifest (path, bytes, records) of archives of pages (page_id, url, html), written to folder."""
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # stored, so that Spark knows its size: small, it is broadcast; large, the join is by digest, and a very frequent one is split as skewed
    again = stored(rows.where(F.octet_length("html") >= REVISIT).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    linked = rows.join(again, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")))
    return stored(linked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(lambda batches: _write(batches, folder), MANIFEST), "warc-manifest")


def decode(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of a whole record."""
    head, mark, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) < int(length):
        return None
    return fields, block[: int(length)]


def members(source, size: int, start: int, stop: int, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(byte, byte after it, decompressed bytes) of the gzip members that start in start..stop and hold a WARC record.

    source: a file with read_at(bytes, position).
    """
    at, lead, lead_at = start, b"", start  # lead: bytes read at lead_at
    while at < stop:
        if not lead_at <= at < lead_at + len(lead) - 2:  # the magic takes three bytes
            lead_at, lead = at, source.read_at(min(block, size - at), at)
            if len(lead) < 18:  # no member is shorter
                return
        found = lead.find(MAGIC, at - lead_at)
        if found < 0:
            at = lead_at + len(lead) - 2
            if lead_at + len(lead) >= size:
                return
            continue
        at = lead_at + found
        if at >= stop:
            return
        unpack, parts, position = zlib.decompressobj(31), [], at
        try:
            chunk = lead[found:]
            seen = 0
            while True:
                part = unpack.decompress(chunk)
                parts.append(part)
                position += len(chunk)
                if not seen and parts:
                    begin = b"".join(parts)[:7]
                    if len(begin) == 7:
                        if not begin.startswith(b"WARC/1."):
                            raise zlib.error("not a record")
                        seen = 1
                if unpack.eof or position >= size:
                    break
                chunk = source.read_at(min(block, size - position), position)
            if not unpack.eof or not seen:
                raise zlib.error("not whole")
        except zlib.error:
            at += 1
            continue
        after = position - len(unpack.unused_data)
        yield at, after, b"".join(parts)
        at = after


def fields_of(record_bytes: bytes) -> tuple | None:
    """A row of RECORDS; of a revisit, size and digest come with its response (`resolve`)."""
    whole = decode(record_bytes)
    if whole is None:
        return None
    fields, block = whole

    def page(value: str) -> int | None:
        tail = value.strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    kind = fields.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if kind == "revisit":
        return page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, None, fields.get("warc-payload-digest", "").rpartition(":")[2], page(fields.get("warc-refers-to", "")), None
    return page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, len(payload), hashlib.sha1(payload).hexdigest(), None, payload


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in f"{RAW}, {RECORDS}".split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_file(name) as source:
                for at, after, data in members(source, size, start, min(start + SPLIT_BYTES, size)):
                    row = fields_of(data)
                    if row is not None:
                        rows.append((path, start, at, after, *(row if payloads else (*row[:6], None))))
                        held += len(row[6] or b"") if payloads else 0
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def _ranges(manifest: DataFrame, payloads: bool) -> DataFrame:
    """RAW and RECORDS of what each range takes for its records."""
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / SPLIT_BYTES))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(SPLIT_BYTES)))
    splits = manifest.select("path", "bytes", starts.alias("start")).repartition(int(total), "path", "start")
    return splits.mapInArrow(lambda batches: _read(batches, payloads), f"{RAW}, {RECORDS}")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of the archives in manifest (path, bytes); with payloads, archives are read twice: first for where records lie."""
    found = stored(_ranges(manifest, False), "warc-records")
    ends = found.groupBy("path", "start").agg(F.min("at").alias("first"), F.max("next").alias("end"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = stored(ends.withColumn("before", F.max("end").over(before)).where("first < before").select("path", "start", "before"), "warc-inside")
    rows = _ranges(manifest, True) if payloads else found
    return rows.join(inside, ["path", "start"], "left").where("before is null or at >= before").select(*(c.split()[0] for c in RECORDS.split(", ")))


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's from the response it refers to."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").select(*columns)
    held = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT).distinct()
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits.join(held, ["refers_to", "payload_digest"], "left").select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as WARC and read back: what `resolve` gives."""
    return resolve(read(write(pages), payloads=False).drop("payload"))


SQL = """
select page_id, payload_bytes, payload_digest, case when newest <> page_id then 'revisit' else 'response' end as record_type,
    case when newest <> page_id then newest end as refers_to
from (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    case when octet_length(encode(coalesce(html, ''))) >= 1000 then max(page_id) over (partition by coalesce(html, '')) else page_id end as newest from pages)
"""
