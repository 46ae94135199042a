"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Reader tasks each take a byte range of a file, scan it for gzip magic, accept a member only if its decoded start is a
WARC header, and own the records that start inside their range; the last of these may end beyond it.

Records with equal payloads of at least ``least_bytes`` share one response, that with the largest page_id; the others
are revisits, whose blocks hold the HTTP header alone. Files are written by the tasks themselves, through pyarrow's
file systems, into the shared folder; a manifest table names the files of the attempts that counted.

Defined cases: null html is an empty payload, null url an empty target; a null page_id is no page's, so it never wins
the response from another row; rows that repeat the largest page_id are all responses; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import freeze, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
URN = "urn:tessera:page:"
LEAST_BYTES = 1000
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20


def member(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!*()~.-_')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, size, response_id: the response's page_id where another record has the payload, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1")
    columns = ["page_id", "url", "payload", "digest", "size"]
    long = rows.where(F.col("size") >= least_bytes).join(shared.drop("copies"), ["digest", "size"], "left").select(*columns, "response_id")
    # short payloads need no join, where all empty ones would meet under one key
    return long.union(rows.where(F.col("size") < least_bytes).select(*columns, F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives under ``folder`` (the shared one by default); returns their manifest (path, bytes, records)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        path, records, size = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", 0, 0
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, n, response = (batch.column(k)[i].as_py() for k in range(6))
                data = member(page_id, url, payload, digest, n, response, response is not None and response != page_id)
                out = out or store.open_output_stream(path, compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

    rows = with_roles(pages, least_bytes).select("page_id", "url", "payload", "digest", "size", "response_id")
    written = freeze(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")
    return written.withColumn("folder", F.lit(folder))


class _Source:
    """Bytes of an open file from a place on, read ahead by blocks."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(READ_BYTES)
        self.data += block
        return bool(block)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _starts_record(source: _Source) -> bool:
    """Whether the source's place is a gzip member whose first decoded bytes are a WARC header's."""
    while len(source.data) < 512 and source.more():
        pass
    if not source.data.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(source.data[:512], 7).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of each record that starts in [start, end)."""
    source = _Source(file, start)
    while source.at < end:
        if not _starts_record(source):
            found = source.data.find(MAGIC, 1)
            if found < 0:
                source.skip(max(1, len(source.data) - len(MAGIC) + 1) if source.data else 0)
                if not source.data[len(MAGIC) :] and not source.more():
                    return
            else:
                source.skip(found)
            continue
        offset, parts = source.at, []
        decoder = zlib.decompressobj(31)
        while not decoder.eof:
            if not source.data and not source.more():
                raise ValueError(f"record at {offset} is cut short")
            parts.append(decoder.decompress(source.data))
            rest = decoder.unused_data if decoder.eof else b""
            source.skip(len(source.data) - len(rest))
        yield offset, b"".join(parts)


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(n) if x and (n := x.strip("<>").removeprefix(URN)) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row per record of the files of ``manifest`` (path, bytes, folder); ``payloads=False`` leaves the payload column null."""
    size = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    ranges = manifest.select("folder", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, math.ceil(size)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                rows, held = [], 0
                with store.open_input_file(row["path"]) as file:
                    for _, record in records_in(file, row["start"], row["start"] + split_bytes):
                        x = parse(record)
                        if not payloads:
                            x["payload"] = None
                        rows.append(x)
                        held += len(x["payload"] or b"")
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS h FROM p),
     m AS (SELECT h, n, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h, n HAVING count(*) > 1)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN m.top IS NOT NULL AND m.top IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top IS DISTINCT FROM d.page_id THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n = m.n
"""
