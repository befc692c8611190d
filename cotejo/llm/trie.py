"""Trie of conversation prefixes with counts and subtree sums, in a minimal-perfect-hash node table per shard.

Conversations are ordered by turn (null first; messages of one turn by the MD5 of role and text) and rebuilt from their group's first
one: the first h turns of conversation c - c % GROUP, then c's own turns after its first h. A prefix is named by 128 bits, the XOR of
hashes of (depth, message); a name that stands for two different (prefix, message) pairs raises.

* Shards hold the paths of some conversations, cut into bands of BAND turns, so that neither many conversations nor a long one makes a
  large shard. Each shard enumerates its distinct prefixes, gives them slots by a minimal perfect hash (the name stored in the slot is
  compared, so a foreign name has none) and scatters members and least members into flat arrays.
* Equal nodes of the shards are merged by name. A node's own share of the subtree sums is credited once, in the shard of its smallest
  member, which has all of its ancestors: every conversation owns the lower end of its path. What a conversation owns in deeper
  bands is handed to the end of each band above.
* In each shard the shares go up through parent slots, deepest level first; sums over the shards are the sums of the subtrees.
* Conversations that end at a node are dealt by (node, id) ranges, packed into blocks and hashed in order as a stream, so a node at
  which a third of all conversations end needs no list of them.

Rows without conv_id belong to no conversation and are left out. Null role or text is empty. Repeated rows are messages of their own. An
empty table has no nodes; a rebuilt conversation without turns is a member of the root. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.llm.common import mix64, scratch

GROUP, HEADS = 5, 9
BAND = 4096
SHARD_ROWS = 200_000
_CHUNK_BITS = 10
_BLOCK_IDS = 8_000
_NODE = "shard int, band int, depth int, d1 long, d2 long, e1 long, e2 long, message binary, bytes long, n long, least long"
_SUMS = "d1 long, d2 long, saved long, leaves long, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class PerfectHash:
    """Slots 0 to n-1 for n distinct 128-bit names, level by level: who is alone in a cell stays, the others go on to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(a)), 0
        while len(left):
            cell = self._cell(a[left], b[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(cell, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[cell]]
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        slot = self._find(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix64(a.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
            return (mix64(h ^ b.view(np.uint64)) % np.uint64(cells)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(a[left], b[left], level, len(alone))
            here = alone[cell]
            slot[left[here]] = rank[cell[here]]
            left = left[~here]
        return slot

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 for names that aren't in the table."""
        slot = self._find(a, b)
        if len(self.a):
            slot[(slot >= 0) & ((self.a[slot] != a) | (self.b[slot] != b))] = -1
        return slot


def distinct_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A first row of every distinct name."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[new]


# ---- paths


def _stored(df: DataFrame, what: str) -> DataFrame:
    place = scratch(df.sparkSession, what)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def kept_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def rebuilt(turns: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Roster (conv_id, total turns after rebuilding) and messages (conv_id, depth, total, message, bytes)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    message = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), message.alias("message"),
        F.octet_length(text).cast("long").alias("bytes"), F.coalesce(F.shiftright(F.col("turn").cast("long"), _CHUNK_BITS), F.lit(-(2**60))).alias("chunk"),
    )
    chunk = W.partitionBy("conv_id", "chunk")
    order = [F.col("turn").asc_nulls_first(), F.col("message")]
    rows = rows.withColumn("i", F.row_number().over(chunk.orderBy(*order))).withColumn("size", F.count(F.lit(1)).over(chunk)).drop("turn")
    rows = _stored(rows, "trie-turns")

    heads = rows.where("i = 1").select("conv_id", "chunk", "size")
    sizes = heads.groupBy("conv_id").agg(F.sum("size").alias("len"))
    base = F.col("conv_id") - F.col("conv_id") % group
    roster = sizes.withColumn("base", base).withColumn("h", kept_turns(F.col("conv_id")))
    first = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    roster = roster.join(first, "base", "left").withColumn("given", F.least("h", F.coalesce("base_len", F.lit(0))))
    roster = roster.withColumn("total", F.col("given") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    roster = _stored(roster.select("conv_id", "base", "h", "given", "total"), "trie-roster")

    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = heads.withColumn("before", before).join(roster, "conv_id").select("conv_id", "chunk", "before", "h", "given", "total")
    place = F.col("before") + F.col("i")
    rows = rows.join(placed, ["conv_id", "chunk"]).withColumn("place", place)
    own = rows.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "total", "message", "bytes")
    head = rows.where((F.col("place") < HEADS) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "message", "bytes")
    given = roster.join(head, "base").where("depth <= h").select("conv_id", "depth", "total", "message", "bytes")
    return roster.select("conv_id", "total"), own.unionByName(given).withColumn("depth", F.col("depth").cast("int"))


def named_paths(messages: DataFrame, band: int) -> DataFrame:
    """Messages with the name (d1, d2) of the prefix they end and their own share (e1, e2) of it: the parent's name is the XOR of both."""
    rows = messages.withColumn("band", F.floor((F.col("depth") - 1) / band).cast("int"))
    for i in (1, 2):
        rows = rows.withColumn(f"e{i}", F.xxhash64(F.lit(i), "depth", "message"))
    rows = _stored(rows, "trie-messages")
    parts = rows.where(F.col("total") > band).groupBy("conv_id", "band").agg(*[F.bit_xor(f"e{i}").alias(f"x{i}") for i in (1, 2)])
    above = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("conv_id", "band", *[F.bit_xor(f"x{i}").over(above).alias(f"c{i}") for i in (1, 2)])
    upto = W.partitionBy("conv_id", "band").orderBy("depth")
    rows = rows.join(parts, ["conv_id", "band"], "left")
    for i in (1, 2):
        rows = rows.withColumn(f"d{i}", F.bit_xor(f"e{i}").over(upto).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))))
    return _stored(rows.drop("c1", "c2"), "trie-paths")


# ---- shards


def _of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of a shard's paths with members and least member among them."""
    a, b, conv = _of(rows, "d1"), _of(rows, "d2"), _of(rows, "conv_id")
    first = distinct_names(a, b)
    table = PerfectHash(a[first], b[first])
    slot = table.slot(a, b)
    members = np.bincount(slot, minlength=len(first)).astype(np.int64)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    some = np.empty(len(first), np.int64)
    some[slot] = np.arange(len(a))
    of_node = rows.take(pa.array(some)).select(["shard", "band", "depth", "d1", "d2", "e1", "e2", "message", "bytes"])
    return of_node.append_column("n", pa.array(members)).append_column("least", pa.array(least)).combine_chunks()


def _shard_sums(rows: pa.Table) -> pa.Table:
    """Subtree sums inside a shard. kind 0: its nodes; 1: what deeper bands hand up, by name; 2: nodes of the band above, for their owner."""
    kind, a, b, depth, owner = (_of(rows, c) for c in ("kind", "d1", "d2", "depth", "least"))
    node = np.flatnonzero(kind != 1)
    node = node[distinct_names(a[node], b[node])]
    table = PerfectHash(a[node], b[node])
    at = table.slot(a[node], b[node])
    n = len(node)
    flat = lambda values: _scattered(values[node], at, n)
    share = (_of(rows, "n_convs") - 1) * _of(rows, "bytes")
    mine = flat(_of(rows, "mine").astype(np.int64)) == 1
    saved = np.where(mine, flat(share), 0)
    leaves = np.where(mine, flat((_of(rows, "n_children") == 0).astype(np.int64)), 0)
    handed = np.flatnonzero(kind == 1)
    to = table.slot(a[handed], b[handed])
    np.add.at(saved, to, _of(rows, "saved")[handed])
    np.add.at(leaves, to, _of(rows, "leaves")[handed])
    parent = table.slot(flat(a ^ _of(rows, "e1")), flat(b ^ _of(rows, "e2")))
    depths = flat(depth.astype(np.int64))
    order = np.argsort(-depths, kind="stable")
    cuts = np.concatenate((np.flatnonzero(np.diff(depths[order], prepend=-1)), [n]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        level = order[lo:hi]
        level = level[parent[level] >= 0]
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    owners = flat(owner)
    of_parent = np.where(parent >= 0, owners[parent], 0)
    own = np.flatnonzero(flat(kind.astype(np.int64)) == 0)
    hidden = ~mine[own]
    facts = {"conv_id": owners, "parent_conv_id": of_parent, "n_convs": flat(_of(rows, "n_convs")), "n_children": flat(_of(rows, "n_children"))}
    columns = {"d1": table.a[own], "d2": table.b[own], "saved": saved[own], "leaves": leaves[own], "depth": depths[own].astype(np.int32)}
    masked = {name: pa.array(v[own], mask=hidden | ((parent[own] < 0) & (name == "parent_conv_id"))) for name, v in facts.items()}
    return pa.table(columns | masked)


def _scattered(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, values.dtype)
    out[at] = values
    return out


# ---- ends


def ends_digests(ends: DataFrame, parts: int) -> DataFrame:
    """d1, d2, ends_sha256: of the ids in ascending order joined by commas, for every node at which conversations end."""

    def runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.append(np.flatnonzero(new), len(a))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv_id"))
            edges = runs(a, b).tolist()
            cuts = [x for lo, hi in zip(edges[:-1], edges[1:], strict=True) for x in range(lo, hi, _BLOCK_IDS)]
            texts = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(conv[cuts]), pa.array(texts, pa.string())], ["d1", "d2", "first", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if name != (a, b):
                    if name:
                        done.append((*name, state.hexdigest()))
                    name, state = (a, b), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if done:
                yield _digests(done)
        if name:
            yield _digests([(*name, state.hexdigest())])

    dealt = ends.repartitionByRange(parts, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    blocks = dealt.mapInArrow(pack, "d1 long, d2 long, first long, ids string")
    blocks = blocks.repartition(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return blocks.mapInArrow(join, "d1 long, d2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text)], ["d1", "d2", "ends_sha256"])


# ---- the whole


def prefix_trie(turns: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS, group: int = GROUP) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roster, messages = rebuilt(turns, group)
    all_ = roster.agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("least"), F.coalesce(F.sum("total"), F.lit(0)).alias("rows")).first()
    paths = named_paths(messages, band)
    shards = max(4 * parts, -(-all_["rows"] // shard_rows))
    shard = lambda conv: F.pmod(F.xxhash64(conv), F.lit(shards)).cast("int")

    local = paths.select(shard("conv_id").alias("shard"), "band", "conv_id", "depth", "d1", "d2", "e1", "e2", "message", "bytes")
    local = _stored(local.groupBy("shard", "band").applyInArrow(_shard_nodes, _NODE), "trie-local")

    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    one = same("e1") & same("e2") & same("message") & same("depth")
    nodes = local.groupBy("d1", "d2").agg(
        F.max("depth").alias("depth"), F.max("e1").alias("e1"), F.max("e2").alias("e2"), F.sum("n").alias("n_convs"), F.min("least").alias("least"),
        F.when(one, F.max("bytes")).otherwise(F.raise_error(F.lit("two prefixes have one name")).cast("long")).alias("bytes"),
    )
    nodes = _stored(nodes, "trie-nodes")
    parent = [F.col(f"d{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"d{i}") for i in (1, 2)]
    children = nodes.select(*parent).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.drop("depth", "e1", "e2").join(children, ["d1", "d2"], "left").fillna(0, ["n_children"])
    nothing = [F.lit(0).cast("long").alias(c) for c in ("saved", "leaves")]
    known = _stored(local.drop("message", "bytes", "n", "least").join(known, ["d1", "d2"]), "trie-known")

    held = known.select("*", (shard("least") == F.col("shard")).alias("mine"), *nothing, F.lit(0).alias("kind"))
    above = held.where((F.col("depth") % band == 0)).withColumn("band", F.col("band") + 1).withColumn("kind", F.lit(2)).withColumn("mine", F.lit(False))
    credit = held.where((F.col("band") > 0) & F.col("mine")).groupBy(F.col("least").alias("conv_id"), "band")
    credit = credit.agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    below = W.partitionBy("conv_id").orderBy(F.desc("band"))
    starts = paths.where((F.col("band") > 0) & ((F.col("depth") - 1) % band == 0)).select("conv_id", "band", *parent)
    handed = starts.join(credit, ["conv_id", "band"], "left").fillna(0, ["saved", "leaves"])
    handed = handed.select("conv_id", (F.col("band") - 1).alias("band"), "d1", "d2", F.sum("saved").over(below).alias("saved"), F.sum("leaves").over(below).alias("leaves"))
    handed = handed.where("saved > 0 OR leaves > 0").withColumn("shard", shard("conv_id")).withColumn("kind", F.lit(1)).drop("conv_id")
    sums = held.unionByName(above).unionByName(handed, allowMissingColumns=True).fillna(0).fillna(False, ["mine"])
    sums = sums.groupBy("shard", "band").applyInArrow(_shard_sums, _SUMS)
    most = [F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children")]
    sums = sums.groupBy("d1", "d2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), *most)
    sums = _stored(sums.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(all_["least"])).otherwise(F.col("parent_conv_id"))), "trie-sums")

    top = sums.where("depth = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("saved_tokens", "n_leaves")], F.count(F.lit(1)).alias("n_children")).first()
    root = [(0, 0, top["saved_tokens"], max(top["n_leaves"], 1), 0, all_["least"], None, all_["convs"], top["n_children"])] if all_["convs"] else []
    sums = sums.unionByName(spark.createDataFrame(root, "d1 long, d2 long, saved_tokens long, n_leaves long, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long"))
    ends = paths.where("depth = total").select("d1", "d2", "conv_id")
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(roster.where("total = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id"))
    out = sums.join(ends_digests(ends, parts), ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select(*[F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in _COLUMNS])
