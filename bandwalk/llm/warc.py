"""Deterministic sharded WARC archives: writing, committing and reading back."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from bandwalk.session import settled, wide

DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
SMALLEST = 100
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 9562


def filesystem(uri: str):
    """The pyarrow file system of a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: tuple | None) -> bytes:
    """One WARC/1.1 record with regenerated headers. ``revisits``: a one-element tuple of the response's page id."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + (b"" if revisits else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(revisits[0], digest)}",
                 f"X-Refers-To-Page: {'' if revisits[0] is None else revisits[0]}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Shards:
    """Writes the records of one task into files of about ``roll`` compressed bytes.

    A file has a temporary name with the task's attempt until it is complete, then takes its
    final name. A repeated task writes the same bytes under the same final names.
    """

    def __init__(self, folder: str, roll: int):
        self.fs, self.path = filesystem(folder)
        context = TaskContext.get()
        self.task, self.attempt, self.roll = context.partitionId(), context.taskAttemptId(), roll
        self.number, self.out = 0, None
        self.done: list[dict] = []

    def name(self) -> str:
        return f"shard-{self.task:06d}-{self.number:05d}.warc.gz"

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.path}/.{self.name()}.{self.attempt}.tmp"
            self.out, self.size, self.count, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        member = gzipped(data)
        self.out.write(member)
        self.sum.update(member)
        self.size, self.count = self.size + len(member), self.count + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.path}/{self.name()}"
        if self.fs.get_file_info(final).is_file:  # of an earlier attempt, with the same bytes; some stores do not move onto a file
            self.fs.delete_file(final)
        self.fs.move(self.temporary, final)
        self.done.append({"file": self.name(), "records": self.count, "bytes": self.size, "sha256": self.sum.hexdigest()})
        self.number, self.out = self.number + 1, None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   roll: int = ROLL_BYTES) -> DataFrame:
    """Write one record per page under ``folder`` (shared by all executors) and return the manifest.

    The manifest (file, records, bytes, sha256) is written last, as a table of its own; a
    reader takes the files it lists and no others, so what a lost task left behind does no
    harm. Pages are range-sorted by id, then digest and url; equal input and partition
    number give equal files.

    Of pages with equal payloads of ``SMALLEST`` bytes or more, the one with the smallest id
    (null is largest) is a response and the others are revisits without payload; if the smallest id
    is there more than once, all but one of its rows are revisits of it. Digests alone decide
    this: they are aggregated before they move, and the html moves once, for the sort. Null
    html is an empty payload, null urls become ``urn:page:<id>``. A payload is one record however
    large, and one above ``roll`` fills a file of its own. An empty table gives an empty manifest. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    shared = (
        digests.filter(f"size >= {SMALLEST}").groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    )
    # one mark per (id, digest) that is shared travels with the pages of that id and digest
    marks = digests.join(shared, "digest").select("id", "digest", "first").distinct()
    void = lambda kind: F.lit(None).cast(kind)
    both = rows.select("id", F.lit(1).alias("kind"), "url", "payload", F.sha2("payload", 256).alias("digest"),
                       void("bigint").alias("first")).unionByName(
        marks.select("id", F.lit(0).alias("kind"), void("string").alias("url"), void("binary").alias("payload"), "digest", "first"))
    ordered = both.repartitionByRange(wide(spark), "id", "digest").sortWithinPartitions("id", "digest", "kind", "url")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, roll)
        now, first, told = None, None, False
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "kind", "url", "payload", "digest", "first"))):
                page, kind, url, body, digest, origin = (x.as_py() for x in row)
                if (page, digest) != now:
                    now, first, told = (page, digest), None, False
                if kind == 0:
                    first = (origin,)
                    continue
                revisit = first is not None and (page != first[0] or told)
                told = True
                shards.write(record(page, url, body, digest, first if revisit else None))
        shards.close()
        yield pa.RecordBatch.from_pylist(shards.done, schema=pa.schema(
            [("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return settled(ordered.mapInArrow(run, "file string, records bigint, bytes bigint, sha256 string"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the files in the manifest.

    Files are read as streams of records. A file whose bytes differ from its manifest line,
    or a response whose payload differs from its digest, is an error.
    """
    files = manifest.select("file", "records", "sha256").repartition(wide(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for line in batch.to_pylist():
                rows, size, count = [], 0, 0
                for row in records(fs, f"{path}/{line['file']}", line["sha256"]):
                    rows.append(row)
                    size, count = size + len(row["payload"] or b""), count + 1
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if count != line["records"]:
                    raise ValueError(f"{line['file']}: {count} records, {line['records']} in the manifest")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
                                 "payload_digest string, payload binary")


def records(fs, path: str, expected: str) -> Iterator[dict]:
    """Parsed records of one file, member by member."""
    total, rest = hashlib.sha256(), b""
    with fs.open_input_stream(path, compression=None) as stream:
        z, member = zlib.decompressobj(31), []
        while True:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    break
                total.update(rest)
            member.append(z.decompress(rest))
            rest = z.unused_data
            if z.eof:
                yield parsed(b"".join(member))
                z, member = zlib.decompressobj(31), []
        if member:
            raise ValueError(f"{path}: ends within a record")
    if total.hexdigest() != expected:
        raise ValueError(f"{path}: differs from the manifest")


def parsed(data: bytes) -> dict:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    response = fields["WARC-Type"] == "response"
    if response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != number("X-Payload-Length")):
        raise ValueError(f"page {fields['X-Page-Id']}: payload differs from its digest")
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Page"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest,
            "payload": payload if response else None}
