"""WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest; of equal payloads that are long enough, the one with the smallest id is
the response and the others become revisit records that name it and carry no payload. Payloads themselves move once, to the task
that writes them. An archive is a file of gzip members, one for each record, in the shared folder; a table lists the finished files
with their sizes, so files of tasks that failed are never read.

A null payload is empty. Rows that repeat the smallest id with the same payload are responses too. Null ids count as larger than
any other and aren't written into headers. Headers carry the length of the whole payload, so a revisit needs no look at its response. Empty tables write no archive and give no rows. Further columns don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.common import scratch

REVISIT_BYTES = 100
FILE_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """id and digest of pages whose payload stands elsewhere, with id and address of that response: only revisits are returned."""
    heads = pages.select(
        F.col(id_col).alias("id"), F.col(url).alias("url"), F.octet_length(F.coalesce(payload, F.lit(""))).alias("bytes"), F.sha2(F.coalesce(payload, F.lit("")), 256).alias("digest")
    )
    heads = heads.where((F.col("bytes") >= least) & F.col("id").isNotNull())
    first = heads.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    met = heads.join(first, "digest").where("id <> first.id")
    return met.select("id", "digest", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def record_id(url: str | None, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _line(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ")


def record(kind: str, url: str | None, page_id: int | None, digest: str, payload: bytes, date: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record with fresh headers. A revisit names record, address and date of its response and has no payload."""
    name = lambda i: f"<urn:page:{i}>"
    body = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {name(page_id)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_url, refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_line(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {name(refers_to)}"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def file_record(name: str, date: str) -> bytes:
    """The warcinfo record at the beginning of a file."""
    body = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", url: str = "url", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns the table of files (path, bytes, records) from the tasks that succeeded."""
    revisits = resolve(pages, id_col, payload, url)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        blob, records, done = io.BytesIO(), 0, []

        def flush() -> None:
            nonlocal blob, records
            if records:
                name = f"{uuid.uuid4().hex}.warc.gz"
                first = gzip.compress(file_record(name, date), 1, mtime=0)
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(first)
                    out.write(blob.getvalue())
                done.append((f"{root}/{name}", len(first) + blob.tell(), records))
            blob, records = io.BytesIO(), 0

        for batch in batches:
            for r in batch.to_pylist():
                kind = "response" if r["refers_to"] is None else "revisit"
                data = record(kind, r["url"], r["id"], r["digest"], r["payload"].encode("utf-8", "replace"), date, r["refers_to"], r["refers_url"])
                blob.write(gzip.compress(data, 1, mtime=0))
                records += 1
                if blob.tell() >= FILE_BYTES:
                    flush()
        flush()
        if done:
            path, size, n = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["path", "bytes", "records"])

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    table = f"{folder}-files"
    rows.select("id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(write, "path string, bytes long, records long").write.parquet(table)
    return pages.sparkSession.read.schema("path string, bytes long, records long").parquet(table)


def records_in(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record of an archive stream."""
    with gzip.GzipFile(fileobj=data) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("not a WARC record")
            fields: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip()] = value.strip()
            payload = stream.read(int(fields["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("record without end")
            yield fields, payload


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of a page: page_id, record_type, refers_to, url, payload_digest, payload (null for revisits), payload_bytes."""
    number = lambda v: int(v.removeprefix("<urn:page:").removesuffix(">")) if v else None
    columns = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload", "payload_bytes"]
    spread = max(2, files.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_file(path) as data:
                    for head, payload in records_in(data):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload in {path}")
                        rows.append((number(head.get("X-Page-ID")), kind, number(head.get("X-Refers-To-Page-ID")), head["WARC-Target-URI"], digest, payload.decode() if kind == "response" else None, int(head["X-Payload-Length"])))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    return files.repartition(spread, "path").mapInArrow(read, "page_id long, record_type string, refers_to long, url string, payload_digest string, payload string, payload_bytes long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages into archives of a new shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
