"""N-gram Jaccard join: size-aware, heavy-light.

A document's set holds its distinct k-word shingles as 64-bit hashes. Equal sets are one node. Two nodes link when
100 * intersection >= percent * union.

* Small sets list, for every partner size that could link, all subsets of just the size that such a pair must share; two sets of
  these sizes link exactly if they list the same subset, so nothing needs a check.
* Large sets scan inverted lists. Shingles have one global order, with those of many documents last; only the first ones, of which
  linked sets must share `SHARED`, are posted. Postings are written once in blocks of packed arrays. Short fingerprints of a block's
  keys go to the buckets of these keys and a bit for each comes back, so a key of one document is dropped before it becomes a row (a
  fingerprint that meets another one only keeps a row too many). Size, position and a histogram bound (all exact, never dropping a
  link) precede the count of the common shingles.
* The boundary is where the subsets of a size cost more rows than its postings and their expected candidates.

Only classes are wanted, so members of a list are first checked against one central member, then against random ones; what hangs
together after that needs no more checks. Members of a list that are still in different classes meet where the shingle can be the first one that
they have in common: the rest of both sets behind it must still hold as many shingles as linked sets share. No link between different
classes is lost, and large groups of copies never expand into all pairs.

Sets are named by 64 bits; the few names that a second hash shows to stand for several sets are replaced by that hash.

Null, empty and blank texts have empty sets and link with nothing. Repeated rows have equal sets. With null ids the class is the
smallest id that isn't null. Further columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.common import Shelf, bounded_batches, mix64, text_chunks
from cotejo.llm.components import components

WORDS, PERCENT = 4, 85
#: The commonest shingles known to the global order; they go last. It only shapes the order, never the answer.
HEAVY = 1 << 17
#: Postings that linked sets have in common at least; prefixes are as much longer.
SHARED = 3
_BLOCK = 500_000  # shingles among which repeats are looked for
_BINS = 32
_CHUNK = 150_000  # characters hashed at once
_HELD = 1_000_000  # shingles of texts that a task keeps while it compares pairs
_SEEN = 50_000  # sets remembered as done within a task
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 26
_POSTINGS = 250_000  # of a block
_BUCKET = 2_000_000  # fingerprints that meet in a task
_LARGEST_SMALL = 24
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up[:n], cls.down[:n]


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """For every text its distinct shingles as sorted unsigned 64-bit hashes."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    up, down = _Powers.get(len(data) + 1)
    word = ~_GAP[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_FOLD[data] * up[: len(data)])))
    h = mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(c) + 1 for c in coded])
    begin = np.searchsorted(first, np.concatenate(([0], ends[:-1])))
    stop = np.searchsorted(first, ends)
    odd = [np.uint64(pow(_BASE, 2 * i + 1, 1 << 64) | 1) for i in range(1, k + 1)]
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        runs = np.zeros(n, np.uint64)
        for i in range(k):
            runs += h[i : i + n] * odd[i]
        runs = mix64(runs)
        sets = []
        for a, b in zip(begin, stop, strict=True):
            if b - a >= k:
                own = np.sort(runs[a : b - k + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for i in range(b - a):
                    whole += h[a + i] * odd[i]
                sets.append(mix64(whole * odd[-1]))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def set_id(own: np.ndarray, seed: int = 0) -> int:
    """Signed 64-bit digest of a set, the name of its node."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([mix64((own + np.uint64(seed)) * np.uint64(_BASE)).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))
    return int(h.view(np.int64)[0])


def node_id(own: np.ndarray, shared: frozenset[int]) -> int:
    """The name of a set, where `shared` are the names that stand for several sets."""
    name = set_id(own)
    return set_id(own, 1) if name in shared else name


# ---- sizes


def overlap(a: int, b: int, percent: int) -> int:
    """Least number of common shingles of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), n * 100 // percent + 1)


def prefix(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + SHARED)


def subset_rows(n: int, percent: int) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent))


def boundary(sizes: dict[int, int], percent: int, candidates: float = 4.0) -> int:
    """Largest size of small sets: the one of least cost in rows. A posting costs its row and about `candidates` checks' worth."""
    best, at, cost = 0.0, 0, 0.0
    for n in range(1, _LARGEST_SMALL + 1):
        cost += sizes.get(n, 0) * (subset_rows(n, percent) - prefix(n, percent) * (1 + candidates))
        if cost < best:
            best, at = cost, n
    return at


def subset_keys(own: np.ndarray, percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (smaller size, larger size, subset) for all partner sizes up to `largest`; -1 if both sizes are the same, else -2."""
    n = len(own)
    keys, even = [], []
    with np.errstate(over="ignore"):
        parts = mix64(own)
        total = parts.sum(dtype=np.uint64)
        by_removed: dict[int, np.ndarray] = {}
        for m in range(partners(n, percent).start, min(partners(n, percent).stop, largest + 1)):
            r = n - overlap(n, m, percent)
            if r not in by_removed:
                gone = np.array([parts[list(c)].sum(dtype=np.uint64) for c in itertools.combinations(range(n), r)], np.uint64)
                by_removed[r] = total - gone
            keys.append(mix64(by_removed[r] + np.uint64(min(n, m) * 1_000_003 + max(n, m)) * np.uint64(_BASE)))
            even.append(np.full(len(keys[-1]), -1 if m == n else -2, np.int32))
    return np.concatenate(keys), np.concatenate(even)


# ---- passes over the texts


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, n, set id, second hash, histogram of a row; kind 1: a shingle (in sid) and in how many sets of a block it stands, if in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def common() -> Iterator[pa.RecordBatch]:
            if block:
                value, count = np.unique(np.concatenate(block), return_counts=True)
                value, count = value[count > 1], count[count > 1]
                yield out(1, pa.nulls(len(value), kind), count, value.view(np.int64), pa.nulls(len(value), pa.int64()), pa.nulls(len(value), pa.list_(pa.int32())))

        def out(what, ids, n, sid, second, bins) -> pa.RecordBatch:
            arrays = [pa.array(np.full(len(n), what, np.int8)), ids, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(second, pa.int64()), bins]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "doc_id", "n", "sid", "second", "bins"])

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for start, texts in text_chunks(batch, "text", _CHUNK):
                sets = shingle_sets(texts, k)
                sids = [set_id(s) for s in sets]
                bins = [np.bincount((s >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS).astype(np.int32) for s in sets]
                yield out(0, batch.column("doc_id").slice(start, len(texts)), [len(s) for s in sets], sids, [set_id(s, 1) for s in sets], pa.array(bins, pa.list_(pa.int32())))
                for s, sid in zip(sets, sids, strict=True):
                    if (sid, len(s)) not in seen:
                        seen.add((sid, len(s)))
                        block.append(s)
                        size += len(s)
                if size >= _BLOCK:
                    yield from common()
                    block, size, seen = [], 0, set()
        yield from common()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"kind byte, doc_id {kind}, n long, sid long, second long, bins array<int>")


def _blocks(docs: DataFrame, k: int, percent: int, small: int, heavy, shared) -> DataFrame:
    """Subset keys of small sets (place below 0) and postings of the others, packed: one row for each block of sets.

    keys, place and node (which of the block's sets) go together, as do sids and sizes. A block's equal sets give theirs once.
    """
    from_size = -(-percent * (small + 1) // 100)  # smaller ones have no partner among the large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, rank = heavy.value
        number, part = 0, TaskContext.get().partitionId()
        seen: set[tuple[int, int]] = set()
        parts: dict[str, list[np.ndarray]] = {c: [] for c in ("keys", "place", "node")}
        sids, sizes, held = [], [], 0

        def block() -> pa.RecordBatch:
            columns = {c: np.concatenate(v) for c, v in parts.items()} | {"sids": np.array(sids, np.int64), "sizes": np.array(sizes, np.int32)}
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *[pa.array([v.tobytes()], pa.binary()) for v in columns.values()]], ["block", *columns])

        for batch in batches:
            for _, texts in text_chunks(batch, "text", _CHUNK):
                for own in shingle_sets(texts, k):
                    n = len(own)
                    sid = node_id(own, shared.value)
                    if n == 0 or (sid, n) in seen:
                        continue
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen.add((sid, n))
                    if n <= small:
                        got, even = subset_keys(own, percent, small)
                        parts["keys"].append(got)
                        parts["place"].append(even)
                    if n >= from_size:
                        order = own >> np.uint64(1)
                        if len(value):
                            at = np.minimum(np.searchsorted(value, own), len(value) - 1)
                            late = value[at] == own
                            order[late] = rank[at[late]] | np.uint64(1 << 63)
                        p = prefix(n, percent)
                        parts["keys"].append(own[np.argsort(order, kind="stable")[:p]])
                        parts["place"].append(np.arange(p, dtype=np.int32))
                    new = sum(map(len, parts["keys"][len(parts["node"]) :]))
                    parts["node"] += [np.full(len(x), len(sids), np.int32) for x in parts["keys"][len(parts["node"]) :]]
                    sids.append(sid)
                    sizes.append(n)
                    held += new
                    if held >= _POSTINGS:
                        yield block()
                        parts, sids, sizes, held, number = {c: [] for c in parts}, [], [], 0, number + 1
        if held:
            yield block()

    return docs.select("text").mapInArrow(run, "block long, keys binary, place binary, node binary, sids binary, sizes binary")


def _fingerprints(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, sorted distinct fingerprints, which of them each of the block's keys is or -1) for every bucket that has keys."""
    with np.errstate(over="ignore"):
        h = mix64(keys * np.uint64(_BASE))
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    short = h.astype(np.uint32)
    order = np.lexsort((short, bucket))
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(keys))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[lo:hi]
        value, which = np.unique(short[rows], return_inverse=True)
        yield int(bucket[rows[0]]), value, (rows, which)


def _postings(blocks: DataFrame, buckets: int) -> DataFrame:
    """key, sid, n, pos of the blocks' keys that stand in several sets, with a few others and with equal sets of several blocks."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys"), strict=True):
                own = [(b, v.tobytes()) for b, v, _ in _fingerprints(np.frombuffer(keys.as_buffer(), np.uint64), buckets)]
                bucket, values = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own)), pa.array(bucket, pa.int64()), pa.array(values, pa.binary())], ["block", "bucket", "values"])

    def answer(asked: pa.Table) -> pa.Table:
        lists = [np.frombuffer(v.as_buffer(), np.uint32) for v in asked.column("values")]
        value, count = np.unique(np.concatenate(lists), return_counts=True)
        several = count > 1
        masks = [np.packbits(several[np.searchsorted(value, own)]).tobytes() for own in lists]
        return asked.select(["block", "bucket"]).append_column("mask", pa.array(masks, pa.binary()))

    def place(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        masks = {b: np.unpackbits(np.frombuffer(m, np.uint8)) for b, m in zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist(), strict=True)}
        out = []
        for r in blocks.to_pylist():
            keys, pos, node = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["place"], np.int32), np.frombuffer(r["node"], np.int32)
            go = np.zeros(len(keys), bool)
            for bucket, value, (rows, which) in _fingerprints(keys, buckets):
                go[rows] = (masks[bucket][which] == 1) | (np.bincount(which, minlength=len(value))[which] > 1)
            of = node[go]
            out.append(pa.table({"key": keys[go].view(np.int64), "sid": np.frombuffer(r["sids"], np.int64)[of], "n": np.frombuffer(r["sizes"], np.int32)[of], "pos": pos[go]}))
        return pa.concat_tables(out)

    asked = blocks.select("block", "keys").mapInArrow(ask, "block long, bucket long, values binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, mask binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, "key long, sid long, n int, pos int")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _texts_of(docs: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """(key, packed): the packed texts of the wanted (key) rows, and of a few more that a filter of bounded size lets through."""
    size = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * count).bit_length()))
    slots = lambda key: [F.pmod(F.xxhash64(F.lit(i), key), F.lit(size)) for i in (1, 2)]
    marks = wanted.select(F.explode(F.array(*slots(F.col("key")))).alias("s")).groupBy(F.shiftright("s", 5).alias("at"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(size >> 5, np.uint32)
    bits[marks["at"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, pack = sent.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            go = np.ones(batch.num_rows, bool)
            for name in ("s1", "s2"):
                s = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                go &= (mask[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1) == 1
            chosen = batch.filter(pa.array(go))
            blobs = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in chosen.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chosen.column("key"), pa.array(blobs, pa.binary())], ["key", "packed"])

    key = _key(F.col("doc_id"))
    rows = docs.select(key.alias("key"), "text", *[s.alias(f"s{i}") for i, s in enumerate(slots(key), 1)])
    return rows.mapInArrow(run, "key string, packed binary")


def _verified(met: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """The pairs (a, b) of `met` (a, b, packed_a, packed_b) whose texts are those sets and link, by counting common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: dict[bytes, tuple[int, np.ndarray]] = {}
        room = 0

        def of(blob: bytes) -> tuple[int, np.ndarray]:
            nonlocal room
            if blob not in held:
                own = shingle_sets([unpack.decompress(blob).decode("utf-8", "surrogatepass")], k)[0]
                room += len(own) + len(blob) // 8
                if room > _HELD:
                    held.clear()
                    room = 0
                held[blob] = (node_id(own, shared.value), own)
            return held[blob]

        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("packed_a"), batch.column("packed_b"), strict=True)):
                (sx, own), (sy, other) = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(own, other, assume_unique=True)) if (sx, sy) == (a[i], b[i]) else 0
                good[i] = both and 100 * both >= percent * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return met.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


# ---- pairs


def _need(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def _could_link(na: Column, nb: Column, ba: Column, bb: Column, percent: int) -> Column:
    """Size bound, and the histogram bound: bins of two sets can't differ by more than their shingles do."""
    apart = F.aggregate(F.zip_with(ba, bb, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart <= na + nb - 2 * _need(na, nb, percent))


class _Join:
    """One run of the join: its documents, nodes and written tables."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.docs, self.k, self.percent = docs, k, percent
        self.spark, self.shelf = docs.sparkSession, Shelf(docs.sparkSession, "ngram-join")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that size and histogram bounds allow, with the keys of a document of each."""
        at = lambda s: self.nodes.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("bins").alias(f"bins{s}"), _key(F.col("doc_id")).alias(f"key{s}"))
        met = pairs.distinct().join(at("a"), "a").join(at("b"), "b")
        return met.where(_could_link(F.col("na"), F.col("nb"), F.col("binsa"), F.col("binsb"), self.percent)).select("a", "b", "keya", "keyb")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. Texts travel packed, a fraction of the size of their sets, and are told apart where they meet."""
        pairs = self.shelf.put(self.bounded(pairs))
        wanted = self.shelf.put(pairs.select(F.col("keya").alias("key")).unionAll(pairs.select(F.col("keyb").alias("key"))).distinct())
        texts = _texts_of(self.docs, wanted, wanted.count())
        met = pairs.join(texts.withColumnsRenamed({"key": "keyb", "packed": "packed_b"}), "keyb").join(texts.withColumnsRenamed({"key": "keya", "packed": "packed_a"}), "keya")
        out = self.shelf.put(_verified(met, self.k, self.percent, self.shared))
        self.shelf.drop(pairs, wanted)
        return out

    def open_lists(self, posts: DataFrame, edges: DataFrame) -> DataFrame:
        """The postings of lists that hold several classes, with each node's class so far."""
        roots = components(edges).withColumnRenamed("node", "sid")
        listed = self.shelf.put(posts.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
        several = listed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        out = self.shelf.put(listed.join(several, "key", "left_semi"))
        self.shelf.drop(listed)
        return out

    def classes(self) -> DataFrame:
        spark, shelf, percent = self.spark, self.shelf, self.percent
        survey = shelf.put(_survey(self.docs, self.k))
        members = survey.where("kind = 0").select("doc_id", "n", "sid", "second", "bins")
        common = survey.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(HEAVY).toPandas()
        value = common["sid"].to_numpy(np.int64).view(np.uint64)
        rank = np.arange(len(value), 0, -1).astype(np.uint64)
        by_value = np.argsort(value)
        heavy = spark.sparkContext.broadcast((value[by_value], rank[by_value]))

        named = members.where("n > 0").groupBy("sid", "second").agg(F.min("n").cast("int").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bins").alias("bins"))
        named = shelf.put(named)
        # about the number of sets squared by 2^-65: none in any corpus of today
        clashes = [r["sid"] for r in named.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sid").collect()]
        self.shared = spark.sparkContext.broadcast(frozenset(clashes))
        name = F.when(F.col("sid").isin(clashes), F.col("second")).otherwise(F.col("sid")) if clashes else F.col("sid")
        self.nodes = named.withColumn("sid", name).drop("second")
        members = members.select("doc_id", "n", name.alias("sid"))
        sizes = {r["n"]: r["count"] for r in self.nodes.where(F.col("n") <= _LARGEST_SMALL).groupBy("n").count().collect()}
        small = boundary(sizes, percent)

        blocks = shelf.put(_blocks(self.docs, self.k, percent, small, heavy, self.shared))
        total = blocks.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0)).alias("bytes")).first()["bytes"] // 8
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // _BUCKET))
        keys = shelf.put(_postings(blocks, buckets))
        shelf.drop(blocks)

        edges = shelf.put(_small_edges(keys.where("pos < 0")))
        posts = keys.where("pos >= 0")
        several = posts.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("key")
        posts = shelf.put(posts.join(several, "key", "left_semi").groupBy("key", "sid").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
        shelf.drop(keys)
        enough = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9))
        rich = posts.groupBy("sid").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(F.col("k") >= enough)
        ranked = posts.join(rich.select("sid", (F.col("k") / F.col("n")).alias("share")), "sid")
        old, posts = posts, shelf.put(ranked)
        shelf.drop(old)

        # first round: every node against the most central member of its lists, the one with the largest share of listed shingles
        centre = posts.groupBy("key").agg(F.max(F.struct("share", F.col("sid").alias("p"), F.col("n").alias("np"))).alias("m"))
        near = posts.join(centre, "key").where((F.col("m.p") != F.col("sid")) & (F.least("n", "m.np") * 100 >= F.greatest("n", "m.np") * percent))
        best = near.groupBy("sid").agg(F.max("m").alias("m")).select(F.col("m.p").alias("a"), F.col("sid").alias("b"))
        edges = shelf.put(edges.unionAll(self.linked(best)))

        # second round: against random members of other classes, up to four each
        left = self.open_lists(posts, edges)
        shelf.drop(posts)
        pick = left.groupBy("key").agg(F.min_by(F.struct("sid", "n", "root"), F.xxhash64("key", "sid")).alias("m"))
        near = left.join(pick, "key").where((F.col("m.root") != F.col("root")) & (F.least("n", "m.n") * 100 >= F.greatest("n", "m.n") * percent))
        some = near.select("sid", F.col("m.sid").alias("a")).distinct().groupBy("sid", F.pmod(F.xxhash64("a"), F.lit(4)).alias("r")).agg(F.min("a").alias("a"))
        edges = shelf.put(edges.unionAll(self.linked(some.select("a", F.col("sid").alias("b")))))

        # last: members of a list that are still apart, where the shingle can be the first one in common
        old, left = left, self.open_lists(left.drop("root"), edges)
        shelf.drop(old)
        edges = shelf.put(edges.unionAll(self.linked(_first_in_common(left, percent))))
        shelf.drop(left)

        # the smallest id by node first, then by class; members follow their node
        cls = self.nodes.select("sid", "doc_id").join(components(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        out = members.join(_least_of_class(cls), "sid", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _least_of_class(nodes: DataFrame) -> DataFrame:
    """sid, least: the smallest doc_id of the node's class. Nodes alone in their class need no join."""
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    together = least.where("c > 1").drop("c")
    return nodes.join(together, "root", "left").select("sid", F.coalesce("least", "doc_id").alias("least"))


def _first_in_common(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes in one list, unless what is left of either set from this shingle on is too little for a link."""
    x = left.select("key", *[F.col(c).alias(f"{c}1") for c in ("sid", "n", "pos", "root")])
    y = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "pos", "root")])
    c = F.col
    need = _need(c("n1"), c("n2"), percent)
    first_in_order = (c("n1") < c("n2")) | ((c("n1") == c("n2")) & (c("sid1") < c("sid2")))
    in_reach = (F.least(c("n1") - c("pos1"), c("n2") - c("pos2")) >= need) & (c("n1") * 100 >= c("n2") * percent)
    met = x.alias("x").join(y.alias("y"), (c("x.key") == c("y.key")) & (c("root1") != c("root2")) & first_in_order & in_reach)
    return met.select(c("sid1").alias("a"), c("sid2").alias("b"))


def jaccard_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    bounded_batches(docs.sparkSession)
    return _Join(docs, k, percent).classes()


def _small_edges(keys: DataFrame) -> DataFrame:
    """All sets that list a key of two sizes hang together if both sizes occur (or the sizes are the same): a star for each key."""
    groups = keys.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("pos").alias("even"))
    groups = groups.where("a <> hi AND (even = -1 OR least <> most)").select("key", "a")
    return keys.join(groups, "key").where("a <> sid").select("a", F.col("sid").alias("b"))
