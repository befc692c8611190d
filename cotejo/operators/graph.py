"""Connected groups of flagged tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotejo.session import cut_lineage

#: side of the blocks whose tiles one task connects
BLOCK = 128


def _block_labels(tiles: pa.Table) -> pa.Table:
    """Names the connected groups of one block by their smallest tile: minima run along rows and columns until nothing changes."""
    ty, tx = (tiles.column(c).to_numpy() for c in ("ty", "tx"))
    y, x = ty - ty.min(), tx - tx.min()
    none = np.iinfo(np.int64).max
    order = np.argsort(ty.astype(np.int64) * (1 << 31) + tx, kind="stable")
    label = np.full((y.max() + 1, x.max() + 1), none)
    label[y[order], x[order]] = np.arange(len(order))
    there = label < none
    below, beside = there[1:] & there[:-1], there[:, 1:] & there[:, :-1]
    while True:
        before = label.copy()
        for lines, joined in ((label, below), (label.T, beside.T)):
            for i in [*range(1, len(lines)), *range(-2, -len(lines) - 1, -1)]:
                last, both = (i - 1, joined[i - 1]) if i > 0 else (i + 1, joined[i + 1])
                lines[i] = np.where(both, np.minimum(lines[i], lines[last]), lines[i])
        if (before == label).all():
            break
    own = order[label[y, x]]
    return tiles.append_column("ly", pa.array(ty[own])).append_column("lx", pa.array(tx[own]))


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents to the end by doubling: each step halves the remaining distance."""
    while True:
        up = parents.select("image_id", F.col("a").alias("p"), F.col("p").alias("_pp"))
        nxt = cut_lineage(
            parents.join(up, ["image_id", "p"], "left").select("image_id", "a", F.coalesce("_pp", "p").alias("q"), (F.coalesce("_pp", "p") != F.col("p")).alias("_moved"))
        )
        moved = not nxt.where("_moved").isEmpty()
        parents = nxt.select("image_id", "a", F.col("q").alias("p"))
        if not moved:
            return parents


def connected_tiles(flags: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, ty, tx) of flagged tiles to their component, named by its smallest tile.

    Groups inside a block of tiles are named in one task each. Only tiles at block borders make edges, between groups, which are then
    contracted: every group hooks onto its smallest neighbouring group, chains are shortened by doubling, and edges inside a group
    disappear. Rounds grow with the logarithm of the number of blocks that a component crosses.
    """
    node = lambda y, x: F.col(y).cast("bigint") * (1 << 31) + F.col(x)
    kind = flags.schema["image_id"].dataType.simpleString()
    tiles = flags.select("image_id", F.col("ty").cast("bigint").alias("ty"), F.col("tx").cast("bigint").alias("tx")).distinct()
    at = [F.floor(F.col(c) / block).alias(f"b{c}") for c in ("ty", "tx")]
    named = tiles.select("*", *at).groupBy("image_id", "bty", "btx").applyInArrow(_block_labels, f"image_id {kind}, ty bigint, tx bigint, bty bigint, btx bigint, ly bigint, lx bigint")
    labels = cut_lineage(named.select("image_id", "ty", "tx", node("ly", "lx").alias("label")))
    edges = None
    for dy, dx, axis in ((0, 1, "tx"), (1, 0, "ty")):
        first = labels.where(F.pmod(F.col(axis), F.lit(block)) == block - 1).select("image_id", (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.col("label").alias("a"))
        second = labels.where(F.pmod(F.col(axis), F.lit(block)) == 0).withColumnRenamed("label", "b")
        part = first.join(second, ["image_id", "ty", "tx"]).select("image_id", "a", "b").distinct()
        edges = part if edges is None else edges.unionByName(part)
    edges = cut_lineage(edges)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("image_id", "a").agg(F.min("b").alias("_b")).select("image_id", "a", F.least("a", "_b").alias("p"))
        root = _roots(cut_lineage(hooks))
        labels = cut_lineage(
            labels.join(root.withColumnsRenamed({"a": "label", "p": "_root"}), ["image_id", "label"], "left").select(
                "image_id", "ty", "tx", F.coalesce("_root", "label").alias("label")
            )
        )
        side = lambda c: root.withColumnsRenamed({"a": c, "p": f"_{c}"})
        moved = edges.join(side("a"), ["image_id", "a"], "left").join(side("b"), ["image_id", "b"], "left")
        moved = moved.select("image_id", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")).where("x != y")
        edges = cut_lineage(moved.select("image_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels.select("image_id", "ty", "tx", F.col("label").alias("component"))


def tile_clusters(flags: DataFrame, min_size: int = 4, tile_w: int = 1, tile_h: int = 1) -> DataFrame:
    """Groups of at least `min_size` tiles with box, size and compactness; compact ones are localized."""
    g = connected_tiles(flags).groupBy("image_id", F.col("component").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("tiles"),
        (F.min("tx") * tile_w).cast("double").alias("x0"),
        (F.min("ty") * tile_h).cast("double").alias("y0"),
        ((F.max("tx") + 1) * tile_w).cast("double").alias("x1"),
        ((F.max("ty") + 1) * tile_h).cast("double").alias("y1"),
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return (
        g.where(F.col("tiles") >= min_size)
        .withColumn("compacidad", area / (F.col("tiles") * float(tile_w * tile_h) + 1e-6))
        .withColumn("localizado", F.col("compacidad") < 6.0)
    )
