"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotejo.session import bounded_batches, cut_lineage, ensure_checkpoint_dir

__all__ = ["Shelf", "bounded_batches", "cut_lineage", "digest", "distinct_segments", "fold_sql", "map_arrow", "mix64", "scratch", "small_batches", "table", "text_chunks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder; driver and executors both reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


class Shelf:
    """Tables written below the shared folder for the steps that follow; what no later step reads can be taken off at once."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.folder, self.places = spark, scratch(spark, what), {}

    def put(self, df: DataFrame) -> DataFrame:
        place = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(place)
        out = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(out)] = (out, place)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that were put here; nothing that is still to be computed may read them."""
        for t in tables:
            _, place = self.places.pop(id(t))
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) pieces of a batch, each of about `most` characters or a single longer text; null is empty."""
    texts = batch.column(column)
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if size and size + n > most:
            yield start, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if len(texts):
        yield start, [t or "" for t in texts.slice(start).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` characters of a text column or of a single longer text; a batch is let go once it is read."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixer for unsigned 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_segments(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a first segment of every distinct one, which of them each segment is), found by hash and compared character by character.

    Segments are `size` code points from `begin`, in ascending order, none empty, and may leave gaps.
    """
    if not len(begin):
        return begin, begin
    upto = np.cumsum(size)
    inside = np.arange(upto[-1], dtype=np.int32) - np.repeat((upto - size).astype(np.int32), size)
    own = points if len(inside) == len(points) else points[np.repeat(begin.astype(np.int32), size) + inside]
    with np.errstate(over="ignore"):
        h = inside.astype(np.uint64)
        h <<= np.uint64(32)
        h += own
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        sums = np.add.reduceat(h, upto - size)
    _, first, which = np.unique(sums, return_index=True, return_inverse=True)
    same = size[first][which] == size
    other = np.repeat(begin[first][which].astype(np.int32), size) + inside
    same &= np.add.reduceat(own != points[np.minimum(other, len(points) - 1)], upto - size) == 0
    odd = np.flatnonzero(~same)  # equal hashes of different segments: each of these stands for itself
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


def digest(col: Column) -> Column:
    """Lower-case hex SHA-256 of a string in UTF-8."""
    return F.sha2(col, 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_sql(text: str) -> str:
    """SQL that lower-cases A-Z and nothing else; plain `lower` where all characters are ASCII."""
    return f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END"
