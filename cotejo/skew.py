"""Helpers that keep one hot key from becoming one slow task.

Nothing here gathers a whole group: work is cut by chunk, cell or sketch first, and only
bounded pieces meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BROADCAST_ROWS = 10_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after counting; a larger table is left to a shuffle join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First row per key by `order`; a mergeable aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def chunked_lag(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column, values: Sequence[str]
) -> DataFrame:
    """`lag` per key without one window over the whole key.

    `chunk` must be a non-decreasing function of `order` within a key. The window runs inside
    (key, chunk); the first row of a chunk takes its predecessor from a small table holding the
    last row of every chunk. Adds `prev_<value>` columns. `order` must be unique within a key.
    """
    df = df.withColumn("_chunk", chunk)
    ends = (
        df.groupBy(*keys, "_chunk")
        .agg(F.max_by(F.struct(*values), F.col(order)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")))
        .select(*keys, "_chunk", "_before")
    )
    inner = W.partitionBy(*keys, "_chunk").orderBy(order)
    out = df.withColumn("_own", F.lag(F.struct(*values)).over(inner)).join(ends, [*keys, "_chunk"], "left")
    prev = F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("_before"))
    return out.select(*[c for c in df.columns if c != "_chunk"], *[prev[v].alias(f"prev_{v}") for v in values])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 2000
) -> DataFrame:
    """Exact interpolated percentiles per key (numpy's default rule), hot keys included.

    A mergeable sketch brackets each wanted rank; only the values inside the bracket are then
    ranked exactly. The bracket holds about 4/accuracy of a key's rows, so no task ever sorts a
    whole key, and equal values collapse to one counted row.
    """
    src = df.where(F.col(value).isNotNull())
    names = list(probs)
    eps = 2.0 / accuracy
    bounds = [b for p in probs.values() for b in (max(0.0, p - eps), min(1.0, p + eps))]
    sketch = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, [float(b) for b in bounds], accuracy).alias("_b"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    ranges = []
    for i, p in enumerate(probs.values()):
        # a bracket must hold a few ranks beyond the sketch's error, so small keys are ranked whole
        small = F.col("_n") <= 4 * accuracy
        lo = F.col("_min") if p - eps <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i])
        hi = F.col("_max") if p + eps >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        ranges.append(F.struct(F.lit(names[i]).alias("name"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi")))
    wanted = sketch.select(*keys, "_n", F.explode(F.array(*ranges)).alias("_r")).select(
        *keys, "_n", "_r.name", "_r.p", "_r.lo", "_r.hi"
    )
    counted = src.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    joined = counted.join(wanted, list(keys))
    below = joined.groupBy(*keys, "name").agg(
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("lo"), F.col("_c"))), F.lit(0)).alias("_below")
    )
    inside = joined.where(F.col("_v").between(F.col("lo"), F.col("hi"))).join(below, [*keys, "name"])
    order = W.partitionBy(*keys, "name").orderBy("_v")
    ranked = inside.withColumn("_end", F.col("_below") + F.sum("_c").over(order))
    # zero-based ranks around p*(n-1)
    pos = F.col("p") * (F.col("_n") - 1)
    at = lambda rank: F.min(F.when(F.col("_end") > rank, F.col("_v")))
    out = ranked.groupBy(*keys, "name").agg(
        at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.first(pos - F.floor(pos)).alias("_f")
    )
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, result)).alias(n) for n in names])


def counted_medians(counted: DataFrame, keys: Sequence[str], bins: int = 4096) -> DataFrame:
    """Exact median per key (numpy's rule) of counted values (keys, v, c): (keys, median).

    A histogram between the key's least and largest value finds the bins of the two middle ranks; only the values of these bins are
    ranked. The bins of a histogram that is refined by ranks hold as many values as the data put there, so values that crowd in one bin
    are split again by their own range in the second histogram.
    """
    keys = list(keys)
    ends = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows, floor = counted.join(ends, keys), F.lit(0)
    base = [*keys, "n", "lo", "hi", "below"]
    rows = rows.withColumn("below", floor.cast("bigint"))
    for _ in range(2):
        width = (F.col("hi") - F.col("lo")) / bins
        slot = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
        rows = rows.withColumn("slot", slot)
        hist = rows.groupBy(*base, "slot").agg(F.sum("c").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.col("below") + F.sum("c").over(W.partitionBy(*keys).orderBy("slot"))
        hist = hist.withColumn("upto", upto)
        # bins that hold one of the two middle ranks, from the first to the last of them
        first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        held = hist.where((F.col("upto") > first) & (F.col("upto") - F.col("c") <= last))
        kept = held.groupBy(*keys).agg(F.min("slot").alias("s0"), F.max("slot").alias("s1"), F.min("a").alias("l2"), F.max("b").alias("h2"), F.min(F.col("upto") - F.col("c")).alias("b2"))
        rows = rows.join(kept, keys).where(F.col("slot").between(F.col("s0"), F.col("s1")))
        rows = rows.select(*keys, "v", "c", "n", F.col("l2").alias("lo"), F.col("h2").alias("hi"), F.col("b2").alias("below"))
    end = F.col("below") + F.sum("c").over(W.partitionBy(*keys).orderBy("v"))
    ranked = rows.withColumn("end", end)
    at = lambda rank: F.min(F.when(F.col("end") > rank, F.col("v")))
    return ranked.groupBy(*keys).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def pack_chunks(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], size: int) -> DataFrame:
    """One row per (keys, chunk) holding at most `size` rows as a sorted array `rows`.

    `pos` is a zero-based running number inside the key, unique there.
    """
    return (
        df.withColumn("chunk", F.floor(F.col(pos) / size))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(pos, *[c for c in cols if c != pos]))).alias("rows"))
    )


def length_chunks(texts: DataFrame, keys: Sequence[str], text: str, ratio: float, size: int, name: str, cols: Sequence[str]) -> DataFrame:
    """Texts of a key in arrays `name` of about `size` structs of `cols`, by `length_class`, dealt by hash to the chunk `_<name>`.

    Sequences whose matching-block ratio reaches `ratio` are in the same length class or in neighbouring ones.
    """
    step = math.log((2 - ratio) / ratio)
    own = F.floor(F.log(F.greatest(F.length(text), F.lit(1)).cast("double")) / step).cast("int")
    at = [*keys, "length_class"]
    d = texts.withColumn("length_class", own)
    count = d.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    dealt = d.join(count, at).withColumn(f"_{name}", F.pmod(F.xxhash64(text), F.col("_n")))
    return dealt.groupBy(*at, f"_{name}").agg(F.collect_list(F.struct(*cols) if len(cols) > 1 else F.col(cols[0])).alias(name))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repartition for work that is heavy per row: a fixed number of parts, so that small data is not
    folded into one task at run time."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(k) for k in keys])


#: rows of one task where every row is read by rules of its own
TASK_ROWS = 50_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Number of tasks for the rows of a stored table: one for each core at least, and one for every `rows` rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))


def at_least_parallel(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Spread a table that arrives in few pieces: two for each core at least, and one for every `rows` rows, so that more rows make more
    tasks and not longer ones. A table that arrives in enough pieces stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = tasks_for(df, rows)
    return df.repartition(max(wanted, 2 * cores)) if df.rdd.getNumPartitions() < wanted else df


def chunk_pairs(packed: DataFrame, keys: Sequence[str], ordered: bool = False) -> DataFrame:
    """Pairs of chunks of one key, spread over tasks so that a hot key becomes many equal jobs.

    With `ordered`, both (a, b) and (b, a) are produced; otherwise chunk a <= chunk b.
    """
    left = packed.select(*keys, F.col("chunk").alias("chunk_a"), F.col("rows").alias("rows_a"))
    right = packed.select(*keys, F.col("chunk").alias("chunk_b"), F.col("rows").alias("rows_b"))
    pairs = left.join(right, list(keys))
    if not ordered:
        pairs = pairs.where(F.col("chunk_a") <= F.col("chunk_b"))
    return spread(pairs, [*keys, "chunk_a", "chunk_b"])
