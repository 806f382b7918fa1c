"""A deterministic sharded WARC writer and its reader.

Records are cut into shards by ranges of (page_id, digest) that depend on the data alone, sorted, and written as gzip members to
files that roll by compressed size. Tasks write under temporary names; a manifest of what the successful attempts wrote
decides what is renamed, and the manifest written last is what readers go by. A task that runs twice leaves files that
no manifest names. The same rows give the same files, byte by byte.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import MOST_TASKS, cut_keys, shared_dir, slices, stage

MANIFEST = "temporary string, file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
#: Fixed value: the date of all records, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, headers regenerated from the payload; a revisit carries HTTP headers only."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"WARC-X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    def __init__(self, system: fs.FileSystem, root: str, shard: int, number: int):
        self.final = f"{root}/shard-{shard:07d}-{number:05d}.warc.gz"
        self.temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
        self.stream, self.sum, self.shard, self.records, self.bytes = system.open_output_stream(self.temporary, compression=None), hashlib.sha256(), shard, 0, 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> tuple:
        self.stream.close()
        return self.temporary, self.final, self.shard, self.records, self.bytes, self.sum.hexdigest()


def write_archives(pages: DataFrame, root: str, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, least: int = 100) -> DataFrame:
    """Writes pages(page_id, url, html) as archives under the URI root, and returns the manifest (a table, read back).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of `least` bytes or more those with the
    smallest page_id are responses, the others revisits of it; a null page_id counts as the largest. A page_id that fills more
    than a shard is cut by digest; only rows that agree in page_id and payload always share one.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    ids = stage(pages.select("page_id", "digest", F.octet_length("html").alias("payload_bytes")), "payloads")
    copies = ids.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stage(copies.select("digest", "first"), "copies")
    again = ids.join(copies.hint("merge"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    lead = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    cuts = cut_keys(ids, F.col("page_id"), lead, F.col("payload_bytes") + 512, shard_bytes)

    # what a record refers to travels as a row of its own that sorts before it: html is dealt once
    marks = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind"))
    rows = pages.select("*", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")).unionByName(marks)
    rows = rows.withColumn("shard", cuts.column(F.col("page_id"), lead))
    tasks = min(len(cuts) + 1, MOST_TASKS)
    rows = rows.repartitionById(tasks, F.expr(f"cast(shard * {tasks}L div {len(cuts) + 1}L as int)"))
    rows = rows.sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "digest", "kind", "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(root)
        system.create_dir(path)
        done, out, mark, number = [], None, None, 0
        for batch in slices(batches, "html"):
            for page_id, url, text, digest, first, kind, shard in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "kind", "shard")]):
                if out and (out.shard != shard or out.bytes >= roll_bytes):
                    number = number + 1 if out.shard == shard else 0
                    done.append(out.close())
                    out = None
                if kind == 0:
                    mark = (page_id, digest, first)
                    continue
                revisit = mark is not None and mark[:2] == (page_id, digest)
                if out is None:
                    out = _File(system, path, shard, number)
                out.write(gzip.compress(record(page_id, url, text.encode(), digest, revisit, mark[2] if revisit else None), 6, mtime=0))
        if out:
            done.append(out.close())
        columns = list(zip(*done)) or [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    written = stage(rows.mapInArrow(run, MANIFEST), "written")

    def commit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                if system.get_file_info(temporary).type != fs.FileType.NotFound:  # else an attempt before has renamed it
                    system.move(temporary, final)
            yield batch

    # a table of one row for each file
    return stage(written.mapInArrow(commit, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """The records of the files that the manifest names. A file or payload that does not match its digest is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, digest in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist()):
                with system.open_input_stream(name, compression=None) as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} is not the file that its manifest names")
                columns = list(zip(*map(_parsed, _members(data))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "sha256").repartition(n, "file").mapInArrow(run, RECORDS)


def _members(data: bytes) -> Iterator[bytes]:
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            piece = view[at : at + 65536]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


def _parsed(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block.partition(b"\r\n\r\n")[2]
    kind, length = fields["WARC-Type"], int(fields["WARC-X-Payload-Length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("WARC-X-Page-Id"), length, digest, kind, number("WARC-X-Refers-To-Page-Id"), fields.get("WARC-Target-URI")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives to a new folder of the shared one and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. Empty input writes no file and gives no row; further columns are ignored."""
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, root, **options), root)
