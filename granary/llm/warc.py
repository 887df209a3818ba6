"""WARC archives: written with revisits for equal payloads, read back by tasks that own byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, fresh_path, join_skewed, qualified, utf8

GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_AHEAD = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record as a gzip member of its own. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}", "WARC-Target-URI: " + " ".join((url or "about:blank").split()), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(member: bytes) -> dict | None:
    """What a decoded member says: None for one that is no page's record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not named.get("warc-record-id", "").startswith("<urn:x-page:"):
        return None
    page = lambda key: None if (x := named[key][len("<urn:x-page:") : -1]) == "none" else int(x)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"]
    if kind == "response" and (size != len(payload) or base32_sha1(payload) != digest):
        raise ValueError(f"record {named['warc-record-id']} doesn't hold its payload")
    return {"page_id": page("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to") if kind == "revisit" else None}


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each attempt has its own file; which one counts, the manifest says
        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = file_system(uri)
        out, size = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                page_id, url, html, sha1, refers_to = row
                data = record(page_id, url, html or b"", base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": uri, "size": size}])

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files; their manifest (file, size).

    Of the pages whose payload is the same and has least_bytes or more, that with the largest page_id is a response
    and the others revisit it. A null html is an empty payload. Rows that repeat the largest page_id are all
    responses; so are rows with a null page_id. Other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(utf8("html"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("sha1", F.sha1("html"))
    large = rows.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    kept = cut(large.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "kept")
    own = F.octet_length("html") >= least_bytes
    joined = join_skewed(rows, kept, "sha1", "left")
    joined = joined.withColumn("refers_to", F.when(own & (F.col("first") > F.col("page_id")), F.col("first")))
    folder = qualified(spark, fresh_path(spark, "warc"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return cut(joined.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(_write(folder, date), "file string, size long"), "archives")


def records_in(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end) of a file of size bytes.

    Bytes are searched for gzip's magic. A candidate counts if what it decodes to begins as a WARC record does; after
    a member the next one is expected at once, and searched for from there if it isn't there.
    """
    at, held = start, b""  # held: bytes of the file from at on
    while at < end:
        while (k := held.find(GZIP)) < 0:
            keep = held[-2:] if held else b""
            at, held = at + len(held) - len(keep), keep
            more = source.read_at(min(_AHEAD, size - at - len(held)), at + len(held))
            if not more or at >= end:
                return
            held += more
        at, held = at + k, held[k:]
        if at >= end:
            return
        gz, parts, fed, more = zlib.decompressobj(31), [], at + len(held), held
        try:
            first = gz.decompress(more, 64)
            while len(first) < 7 and not gz.eof and fed < size:
                more = source.read_at(min(_AHEAD, size - fed), fed)
                held, fed = held + more, fed + len(more)
                first += gz.decompress(gz.unconsumed_tail + more, 64)
            if not first.startswith(b"WARC/1."):
                raise zlib.error("no WARC record")
            parts = [first, gz.decompress(gz.unconsumed_tail)]
            rest = held
            while not gz.eof:
                rest = source.read_at(min(_AHEAD, size - fed), fed)
                if not rest:
                    raise EOFError(f"the record at {at} is cut off")
                fed += len(rest)
                parts.append(gz.decompress(rest))
            at, held = fed - len(gz.unused_data), gz.unused_data
            yield b"".join(parts)
        except zlib.error:
            if parts:
                raise
            at, held = at + 1, held[1:]


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, a task for each few ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for uri, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    found = []
                    for member in records_in(f, start, min(start + split_bytes, size), size):
                        if (row := parse(member)) is not None:
                            found.append(row)
                        if len(found) == 1000:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found = []
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return ranges.repartition(parts, "file", "start").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives and reads them back."""
    return read_archives(write_archives(pages, least_bytes))
