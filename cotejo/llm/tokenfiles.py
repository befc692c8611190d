"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps.

Documents are dealt by ranges of doc_id, each range sorted, encoded and written as one shard: `.bin` holds the ids as little-endian
unsigned integers (16 bits when the vocabulary fits, else 32), `.idx` the local start of every document and the end as unsigned
64-bit integers. A table lists the shards; prefix sums over its rows give every shard its base, so a document's place in the whole
sequence is base plus local start, and no task needs to know the others' sizes while it writes.

Null texts are empty documents (the end id alone). Documents with a null id come first; repeated ids stay in one shard, ordered by
text. Empty tables write no shard. Further columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from cotejo.llm.common import scratch
from cotejo.llm.tokens import byte_encoder, read_text, tokenizer

_SHARDS = "shard int, path string, bits int, docs long, tokens long"


def _range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the documents into `parts` ranges of about as many bytes."""
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.length("text").alias("size"))
    weight = F.least(F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(1)), F.lit(2**30)).cast("int")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("by_count"), F.sum(weight.cast("long")).alias("bytes")).first()
    return sorted(set(cuts["by_count"] or []))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, parts: int | None = None) -> DataFrame:
    """Writes the shards and returns their table."""
    spark = docs.sparkSession
    text = read_text(vocabulary)
    sent = spark.sparkContext.broadcast(text)
    bits = 16 if max(tokenizer(text).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 32
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _range_bounds(docs, parts) if parts > 1 else []
    known = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    kind = np.dtype(f"<u{bits // 8}")
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            at = np.searchsorted(known.value, ids.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1
            at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            blobs = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), ids, pa.array(blobs, pa.binary())], ["shard", "doc_id", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        encode, unpack = byte_encoder(sent.value), zstandard.ZstdDecompressor()
        shard, out, path, starts, ids = None, None, "", [0], []

        def close() -> pa.RecordBatch:
            out.close()
            with fs.open_output_stream(f"{path}.idx", compression=None) as index:
                index.write(np.array(starts, "<u8").tobytes())
                index.write(pa.array(ids, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "bits": bits, "docs": len(ids), "tokens": starts[-1]}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("bits", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            shards, doc_ids = batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist()
            for i, packed in enumerate(batch.column("packed")):
                if shards[i] != shard:
                    if out is not None:
                        yield close()
                    shard, path, starts, ids = shards[i], f"{root}/{uuid.uuid4().hex}", [0], []
                    out = fs.open_output_stream(f"{path}.bin", compression=None)
                tokens = encode(unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass")).astype(kind)
                out.write(tokens.tobytes() + tail)
                starts.append(starts[-1] + len(tokens) + (end_id is not None))
                ids.append(doc_ids[i])
        if out is not None:
            yield close()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "shard int, doc_id long, packed binary")
    dealt = packed.repartitionById(parts + 1, "shard").sortWithinPartitions("shard", "doc_id", "packed")
    table = f"{folder}-shards"
    dealt.mapInArrow(write, _SHARDS).write.parquet(table)
    return spark.read.schema(_SHARDS).parquet(table)


def bases(shards: DataFrame) -> DataFrame:
    """The shard table with `base`, the tokens of all shards before; one row for each shard, so one small window."""
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    placed = bases(shards)
    spread = max(2, shards.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)

        def buffer(path: str) -> pa.Buffer:
            if isinstance(fs, pafs.LocalFileSystem):
                if not fs.get_file_info(path).size:
                    return pa.py_buffer(b"")
                with pa.memory_map(path) as data:
                    return data.read_buffer()
            with fs.open_input_file(path) as data:
                return data.read_buffer()

        for batch in batches:
            for s in batch.to_pylist():
                n = s["docs"]
                index = buffer(f"{s['path']}.idx")
                starts, ids = np.frombuffer(index, "<u8", n + 1).astype(np.int64), np.frombuffer(index, "<i8", n, 8 * (n + 1))
                tokens = np.frombuffer(buffer(f"{s['path']}.bin"), f"<u{s['bits'] // 8}")
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=np.full(n, s["shard"] == 0)), pa.array(starts[:-1] + s["base"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.repartition(spread, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int | None = 0) -> DataFrame:
    """Writes a new set of shards and reads it back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_documents(write_shards(docs, folder, vocabulary, end_id), folder)
