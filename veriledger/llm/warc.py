"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

A crawl's archive may be one gzip stream from end to end, which can only be read from the start.
The normaliser inflates such a stream once, in pieces, rewrites each record as a gzip member of its
own and writes a sidecar index of member offsets; after that any record is one seek away.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import bounded_broadcast, new_path, store
from veriledger.llm.files import create, open_at

#: Payloads under this size are always stored.
REVISIT_BYTES = 1000
PIECE = 1 << 20
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{i}:{digest}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(stream) -> Iterator[bytes]:
    """Pieces of a gzip file's content, whether it is one member or many."""
    z = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if out := z.decompress(data, PIECE):
                yield out
            if z.eof:
                data = z.unused_data
                if data:
                    z = zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
        if z.eof:
            z = zlib.decompressobj(31)
    if out := z.flush():
        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an inflated stream; holds one record at a time."""
    held, need = bytearray(), 0
    fields: dict[str, str] | None = None
    for piece in pieces:
        held += piece
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = headers(bytes(held[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            fields = None
    if held:
        raise ValueError(f"the archive ends within a record ({len(held)} bytes)")


def normalise(source: str, target: str, level: int = 5) -> Iterator[tuple]:
    """Rewrite a gzip archive with one member a record, beside it target + ".idx" with a JSON line
    a record; yields the index: archive, offset, length, record id, type."""
    with ExitStack() as files:
        raw, out, idx = files.enter_context(open_at(source)), files.enter_context(create(target)), files.enter_context(create(target + ".idx"))
        at = 0
        for fields, whole in split_records(inflate(raw)):
            member = gzip.compress(whole, level, mtime=0)
            out.write(member)
            row = (target, at, len(member), fields.get("warc-record-id", ""), fields.get("warc-type", ""))
            idx.write(json.dumps(dict(zip(("offset", "length", "id", "type"), row[1:], strict=True))).encode() + b"\n")
            at += len(member)
            yield row


def read_record(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of the member at offset; a revisit has no payload."""
    stream.seek(offset)
    whole = gzip.decompress(stream.read(length))
    head, _, block = whole.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["http"] = http.decode("latin-1")
    return fields, payload


def decide(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to. Of equal payloads of `least` bytes or more the one
    with the largest page_id is stored and the others refer to it; rows that share that page_id are
    all stored, and so are rows without an id if the group has no id. Null html is empty. Only
    digests with repeats take part in the join."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeats = bounded_broadcast(store(long.where("n > 1 and keeper is not null").select("digest", "keeper"), "warc-repeats"))
    out = rows.join(repeats, "digest", "left")
    return out.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, rotate: int = 1 << 30) -> DataFrame:
    """Write decided rows as gzip files that are one stream each; archive, records of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, done = TaskContext.get().partitionId(), 0, []
        each = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(each, None)
        while first is not None:
            path, size, count = f"{folder}/{part:06d}-{n:04d}.warc.gz", 0, 0
            with create(path) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0) as out:
                while first is not None and size < rotate:
                    page_id, url, html, digest, refers_to = first
                    data = record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to)
                    out.write(data)
                    size, count, first = size + len(data), count + 1, next(each, None)
            done.append((path, count))
            n += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return store(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long"), "warc-files")


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive (column archive) in a task; the stored index of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                rows = list(normalise(source, f"{folder}/{source.rpartition('/')[2]}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["archive", "offset", "length", "record_id", "record_type"])

    n = max(1, min(archives.count(), 10_000))
    return store(archives.select("archive").repartition(n).mapInArrow(run, INDEX), "warc-index")


def read_all(index: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and place of every indexed
    record, each read at its offset. A response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != path:
                    if stream:
                        stream.close()
                    path, stream = archive, open_at(archive)
                fields, payload = read_record(stream, offset, length)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(next(x.split(":")[1] for x in fields["http"].split("\r\n") if x.lower().startswith("content-length:")))
                if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"payload of {fields['warc-record-id']} in {archive} is damaged")
                ids = [fields.get("x-page-id"), fields.get("x-refers-to-page")]
                out.append((ids[0], size, digest, fields["warc-type"], ids[1], archive.rpartition("/")[2], offset, length))
            if out:
                c = list(zip(*out, strict=True))
                text = lambda v: pa.array(v, pa.string())
                yield pa.RecordBatch.from_arrays([text(c[0]), pa.array(c[1], pa.int64()), text(c[2]), text(c[3]), text(c[4]), text(c[5]), pa.array(c[6], pa.int64()), pa.array(c[7], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])
        if stream:
            stream.close()

    rows = index.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, offset long, length long")
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise them, read every record back by its offset.

    One row per row of pages, repeated rows included; null ids and urls stay null, null html is an
    empty payload, extra columns are ignored, no pages give no archive and no rows.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    files = write_monolithic(decide(pages), f"{folder}/raw")
    return read_all(normalise_all(files, f"{folder}/records"), dict(pages.dtypes)["page_id"])
