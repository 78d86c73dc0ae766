"""WARC: archives with an index, read back by byte ranges.

Every task writes its pages to archives of bounded size, a gzip member per record, and returns one
index row per record: file, offset, length, URL and digest. The index is written as a table first;
readers choose rows of it, sort them by file and offset, and read neighbouring records together,
in ranges that are bounded by what they unpack to.

Of equal payloads of at least ``MIN_SHARED`` bytes one is stored, the others refer to it. Who is
first is found on (page_id, digest) rows; the pages are shuffled once, by page_id, so that many
copies of one payload don't meet in a task.

Archives go to any store that Arrow reaches by its URI. A task that runs twice writes other files,
and only those of the attempt that ended well are in the index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.storage import fresh_folder, written

from .common import whole

MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
# Records are read together if no more bytes lie between them, up to a range of so many bytes.
GAP_BYTES = 256 << 10
RANGE_BYTES = 8 << 20
# However well records compress, no more of their payloads is unpacked at once, and no more of them.
UNPACKED_BYTES = 8 << 20
RANGE_RECORDS = 2_000
# Payloads that a reading task gets on average.
TASK_BYTES = 64 << 20

INDEX = (
    "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, "
    "file string, offset long, length long"
)
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _field(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed."""
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        fields += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"
        ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's page, type, reference and payload; fails if length or digest don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {size} bytes has another length")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
    page, refers_to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers_to is None else int(refers_to),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _archive_writer(folder: str, archive_bytes: int):
    schema = _schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, out, at, number = TaskContext.get(), None, 0, 0
        try:
            for pages in batches:
                rows = []
                # One page at a time: only the batch itself is held.
                for page in zip(*pages.columns, strict=True):
                    page_id, url, html, digest, refers_to = (value.as_py() for value in page)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                        out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    payload = html.encode()
                    data = gzip.compress(build_record(page_id, url, payload, digest, refers_to), 6, mtime=0)
                    out.write(data)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, digest, len(payload), kind, refers_to, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder`` and returns the index, itself a table.

    Null html is an empty payload; a null url leaves its field out, and line ends in it are written
    as percent codes. Among equal payloads of at least ``MIN_SHARED`` bytes the smallest page_id is
    the response; rows that repeat its id are responses too, and a payload that only rows without
    an id have is stored with each. Further columns are left out. No pages give an empty index.
    """
    digested = pages.select(
        "page_id", "url", whole("html").alias("html"), F.sha2(whole("html").cast("binary"), 256).alias("payload_digest")
    )
    keys = digested.where(F.octet_length("html") >= MIN_SHARED).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = first.where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = (
        keys.join(shared, "payload_digest").where("NOT page_id <=> refers_to").dropDuplicates()
        .select(F.col("page_id").alias("key_id"), F.col("payload_digest").alias("key_digest"), "refers_to")
    )
    marked = digested.join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("key_id")) & (F.col("payload_digest") == F.col("key_digest")),
        "left",
    ).select("page_id", "url", "html", "payload_digest", "refers_to")
    return written(marked.mapInArrow(_archive_writer(folder, archive_bytes), INDEX))


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Sorted index rows in groups that are read at once.

    A group is of one file and bounded by its bytes in the archive, by the bytes of its payloads and
    by its records. A record that is larger is a group of its own.
    """
    group: list[dict] = []
    unpacked = 0
    for row in rows:
        if group:
            last = group[-1]
            end = last["offset"] + last["length"]
            if (
                row["file"] != last["file"] or row["offset"] < end or row["offset"] - end > GAP_BYTES
                or row["offset"] + row["length"] - group[0]["offset"] > RANGE_BYTES
                or unpacked + row["payload_bytes"] > UNPACKED_BYTES or len(group) >= RANGE_RECORDS
            ):
                yield group
                group, unpacked = [], 0
        group.append(row)
        unpacked += row["payload_bytes"]
    if group:
        yield group


def _range_reader(folder: str):
    schema = _schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for index in batches:
            for group in _ranges(index.to_pylist()):
                start = group[0]["offset"]
                with store.open_input_file(f"{root}/{group[0]['file']}") as archive:
                    data = archive.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                found = [
                    parse_record(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                    for r in group
                ]
                yield pa.RecordBatch.from_pylist(found, schema)

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the chosen index rows: page_id, url, type, reference, size, digest, payload.

    Size and digest are those of the full payload; the payload of a revisit is null and that of
    the page it refers to. Tasks get stretches of archives, as many as the payloads need; a task
    holds one range of bounded unpacked size at a time, however well the pages compress.
    """
    stretch = F.expr(f"offset div {2 * RANGE_BYTES}").alias("stretch")
    chosen = index.select("file", "offset", "length", "payload_bytes", stretch)
    total = chosen.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(1, -(-total // TASK_BYTES))
    dealt = chosen.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return dealt.mapInArrow(_range_reader(folder), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives in the shared folder and read back, one row each."""
    folder = fresh_folder(pages.sparkSession)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return read_records(write_archives(pages, folder), folder)
