"""Exact top-k search by integer inner product with MaxScore over shards.

Candidates are dealt into shards of bounded size. In a shard every dimension is a term with the largest and the smallest weight
that a candidate has there, so a query's term has an upper bound. Terms go by falling bound: the essential ones are traversed for
all candidates, the rest are probed one by one, each time only for candidates whose partial score plus the bounds of what is left
can still reach the k-th best score. Shards give at most k rows a query; the best k of these are the answer.

Queries (rows whose id is divisible by a given number) come in blocks that meet every shard. A null vector or one with a null, NaN
or infinite component takes no part; rows with a null id neither. Dimensions that a vector lacks count as 0. Rows with the query's
id are its own and no candidates; other repeated rows each count, ties by smaller id. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

SHARD_ROWS, BLOCK_ROWS, SCALE = 8192, 2048, 1024
_EXACT = 2.0**53


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), held in doubles, without the rows that take no part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floors = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return embeddings.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), floors.alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows.to_list()) if width else np.zeros((len(rows), 0))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the best k candidates of one shard, by falling score and rising id."""
    d = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :d], vectors[:, :d]
    if d and np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * d >= _EXACT:
        queries, vectors = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (queries, vectors))
    postings = np.ascontiguousarray(vectors.T)  # a row for each term
    high, low = postings.max(1), postings.min(1)
    for own, q in zip(query_ids, queries, strict=True):
        upper, lower = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(-(upper - lower).astype(np.float64), kind="stable")
        most = np.concatenate((np.cumsum(upper[order][::-1])[::-1], [0 * upper.sum()]))  # what the terms from here on add at most
        least = np.concatenate((np.cumsum(lower[order][::-1])[::-1], [0 * lower.sum()]))
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(ids), vectors.dtype)[alive]
        floor = None
        if len(alive) > 4 * k and d:
            floor = np.sort(vectors[alive[: 4 * k]] @ q)[-k]
        # the essential terms: a candidate without weight in them can't reach the floor
        essential = d if floor is None else int(np.argmax(most < floor)) if (most < floor).any() else d
        step, t = max(1, d // 8), 0
        while t < d and len(alive):
            ahead = min(d, t + step) if floor is not None else d
            if t < essential < ahead:
                ahead = essential
            for i in order[t:ahead]:
                if q[i]:
                    score = score + q[i] * postings[i][alive]
            t = ahead
            if t < d and len(alive) > k:
                sure = np.partition(score, len(score) - k)[len(score) - k] + least[t]  # k candidates have so much
                floor = max(floor, sure)
                stay = score + most[t] >= floor
                if not stay.all():
                    alive, score = alive[stay], score[stay]
        if vectors.dtype == object:
            best = sorted(range(len(alive)), key=lambda j: (-score[j], ids[alive[j]]))[:k]
        else:
            best = np.lexsort((ids[alive], -score))[:k]
        yield int(own), ids[alive[best]], score[best]


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = scaled(embeddings, id_col, vector, scale)
    queries = rows.where(F.col("vec_id") % every == 0)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // block_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
    pairs = "transform(sequence(0, {n} - 1), i -> i)"
    left = rows.withColumn("shard", deal(shards, 1)).withColumn("block", F.explode(F.expr(pairs.format(n=blocks))))
    right = queries.withColumn("block", deal(blocks, 2)).withColumn("shard", F.explode(F.expr(pairs.format(n=shards))))

    def run(key: tuple, some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(some) and len(asked):
            asked = asked.drop_duplicates("vec_id")
            for own, ids, score in search_shard(asked["vec_id"].to_numpy(), _matrix(asked["v"]), some["vec_id"].to_numpy(), _matrix(some["v"]), k):
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in score]
        return pd.DataFrame(out).astype("int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
