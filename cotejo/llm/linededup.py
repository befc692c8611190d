"""Line dedup that can be undone: exact reference counts per line key, and cuckoo filters over the keys that are too common.

A line's key is the line without white space at its ends and with A-Z in lower case; the index holds its 128-bit digest. `refs` is
the exact table of documents per key. Keys found in at least `threshold` documents also stand in the cuckoo filter of their shard,
so that cleaning asks the small filters first and checks only their positives against the table. Inserting and deleting documents
add to and take from the counts; keys that cross the threshold enter or leave the filters, so deleting a batch restores the state
before it.

Every row is one document: null and empty texts are one empty line, whose key is too short to count; repeated rows count each.
Further columns stay as they are. Empty tables give empty results.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.llm.common import bounded_batches, scratch, small_batches

THRESHOLD = 10
_BLANK = b" \t\n\x0b\x0c\r"
_SALTS = 32


class CuckooFilter:
    """Set of 16-byte keys as 16-bit fingerprints, four to a bucket; each key has two possible buckets, so keys can be deleted."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 1, cells: np.ndarray | None = None) -> None:
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of(cls, keys: list[bytes], buckets: int = 1) -> CuckooFilter:
        """A filter of the given keys, with room enough."""
        while buckets * cls.SLOTS * 0.85 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(map(made.insert, keys)):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(cells=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as pairs of 64-bit numbers."""
        last = np.uint64(len(self.cells) - 1)
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys[:, 0] >> np.uint64(16)) & last
        return mark, one, one ^ (self._step(mark) & last)

    @staticmethod
    def _step(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    @staticmethod
    def numbers(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, one, two = self._places(self.numbers(keys))
        return (self.cells[one] == mark[:, None]).any(1) | (self.cells[two] == mark[:, None]).any(1)

    def insert(self, key: bytes) -> bool:
        """False if no room was found; the filter must then be built anew."""
        mark, one, two = (x[0] for x in self._places(self.numbers([key])))
        for at in (one, two):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        at, last = two, np.uint64(len(self.cells) - 1)
        for kick in range(self.KICKS):
            slot = (int(mark) + kick) % self.SLOTS
            mark, self.cells[at, slot] = self.cells[at, slot], mark
            at = at ^ (self._step(np.array([mark], np.uint16))[0] & last)
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self._places(self.numbers([key])))
        for at in (one, two):
            there = np.flatnonzero(self.cells[at] == mark)
            if len(there):
                self.cells[at, there[0]] = 0
                return True
        return False


def line_keys(text: str | None) -> list[bytes | None]:
    """Digest of the key of every line; None for a line without a key."""
    keys = (line.strip(_BLANK).lower() for line in (text or "").encode("utf-8", "replace").split(b"\n"))
    return [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in keys]


def _shard(key: bytes, shards: int) -> int:
    return int.from_bytes(key[12:16], "little") % shards


def occurrences(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, shard, key): one row for each row of documents and different key in it."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = set(line_keys(text)) - {None}
                rows += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array([_shard(k, shards) for k in keys], pa.int32()), pa.array(keys, pa.binary())],
                ["doc_id", "shard", "key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shard int, key binary")


@dataclasses.dataclass(frozen=True)
class LineIndex:
    """The state: refs (shard, key, n_docs) and filters (shard, filter), both tables in the shared folder."""

    spark: SparkSession
    shards: int
    threshold: int
    refs: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, threshold: int = THRESHOLD, shards: int | None = None) -> LineIndex:
        n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        refs = spark.createDataFrame([], "shard int, key binary, n_docs long")
        return cls(spark, n, threshold, refs, spark.createDataFrame([], "shard int, filter binary"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(occurrences(docs, self.shards), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes documents out again; those that were never inserted must not be given."""
        return self._moved(occurrences(docs, self.shards), -1)

    def _moved(self, rows: DataFrame, sign: int) -> LineIndex:
        change = rows.groupBy("shard", "key").agg((F.count(F.lit(1)) * sign).alias("by"))
        both = self.refs.select("shard", "key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("by")).unionAll(
            change.select("shard", "key", F.lit(0).cast("long").alias("was"), "by")
        )
        counts = both.groupBy("shard", "key").agg(F.sum("was").alias("was"), F.sum(F.col("was") + F.col("by")).alias("n_docs"))
        place = scratch(self.spark, "line-refs")
        counts.where((F.col("n_docs") > 0) | (F.col("was") > 0)).write.parquet(place)
        counts = self.spark.read.schema("shard int, key binary, was long, n_docs long").parquet(place)
        common = counts.where((F.col("n_docs") >= self.threshold) | (F.col("was") >= self.threshold))
        threshold = self.threshold

        def renew(key: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            now, before = keys["n_docs"] >= threshold, keys["was"] >= threshold
            if len(old):
                made = CuckooFilter.load(bytes(old["filter"].iloc[0]))
                fits = all([made.delete(bytes(k)) for k in keys["key"][before & ~now]])
                fits = fits and all(made.insert(bytes(k)) for k in keys["key"][now & ~before])
            else:
                fits = False
            if not fits:
                made = CuckooFilter.of([bytes(k) for k in keys["key"][now]])
            return pd.DataFrame({"shard": [int(key[0])], "filter": [made.dump()]})

        place = scratch(self.spark, "line-filters")
        pairs = common.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        pairs.applyInPandas(renew, "shard int, filter binary").write.parquet(place)
        filters = self.spark.read.schema("shard int, filter binary").parquet(place)
        refs = counts.where(F.col("n_docs") > 0).select("shard", "key", "n_docs")
        return dataclasses.replace(self, refs=refs, filters=filters)

    def too_common(self, rows: DataFrame) -> DataFrame:
        """The keys among `rows` (shard, key) that reach the threshold: filter first, then the exact table.

        Only different keys are asked, so a line that stands in every document weighs no more than any other.
        """
        asked = rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"))

        def probe(key: tuple, keys: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if len(known):
                keys = keys[CuckooFilter.load(bytes(known["filter"].iloc[0])).contains([bytes(k) for k in keys["key"]])]
            return keys[["shard", "key"]] if len(known) else keys.iloc[:0][["shard", "key"]]

        maybe = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "shard int, key binary")
        return maybe.join(self.refs.where(F.col("n_docs") >= self.threshold), ["shard", "key"], "left_semi")

    def clean(self, docs: DataFrame) -> DataFrame:
        """All columns of `docs` with dropped lines gone from `text`, and n_lines, n_dropped, which take the place of given ones."""
        rows = occurrences(docs, self.shards)
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")
        common = self.too_common(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        drops = rows.withColumn("salt", salt).join(common, ["shard", "key", "salt"], "left_semi")
        drops = drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_drop"))
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        rest = [c for c in columns if c != "text"]
        whole = docs.select(F.struct(*[docs[c] for c in rest]).alias("_row"), docs["doc_id"].alias("_doc"), docs["text"].alias("_text"))
        met = whole.join(drops, F.col("_doc").eqNullSafe(F.col("_id")), "left").select("_row", "_text", "_drop")
        schema = met.select("_row", "_text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "_text"):
                kept, n_lines, n_dropped = [], [], []
                for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drop").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    n_lines.append(len(lines))
                    if drop:
                        out = set(drop)
                        left = [line for line, k in zip(lines, line_keys(text), strict=True) if k not in out]
                        n_dropped.append(len(lines) - len(left))
                        kept.append("\n".join(left))
                    else:
                        n_dropped.append(0)
                        kept.append(text)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["_row", "_text", "n_lines", "n_dropped"])

        out = met.mapInArrow(run, schema)
        return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns], "n_lines", "n_dropped")
