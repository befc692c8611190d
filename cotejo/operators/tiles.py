"""Statistics over image tiles: outliers, planes, compression traces, copies and neighbours.

A tile is (image_id, plane, level, ty, tx, px). Pixels are 8-bit, so most statistics go through a
histogram of at most 256 rows per image: the pixels are folded before the shuffle and one large
image never becomes one large group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.session import cut_lineage
from cotejo.skew import chunk_pairs, counted_medians, pack_chunks


def plane(tiles: DataFrame, name: str, level: int = 0) -> DataFrame:
    return tiles.where((F.col("plane") == name) & (F.col("level") == level)).select("image_id", "ty", "tx", "px")


def tile_moments(tiles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance of every tile, inside the row."""
    n = F.size("px")
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    squares = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v)
    return tiles.select("image_id", *keep, "ty", "tx", n.alias("n"), total.alias("s"), squares.alias("q")).withColumns(
        {"mean": F.col("s") / F.col("n"), "var": F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)}
    )


def _share_beyond(values: DataFrame, column: str, k: float, eps: float) -> DataFrame:
    """Share of an image's values further than k deviations from the mean."""
    g = values.groupBy("image_id").agg(F.avg(column).alias("_m"), (F.stddev_pop(column) + eps).alias("_s"))
    far = F.abs(F.col(column) - F.col("_m")) > F.col("_s") * k
    return values.join(g, "image_id").groupBy("image_id").agg(
        F.avg(far.cast("double")).alias("proporcion"), F.count(F.lit(1)).alias("bloques"), F.first("_m").alias("media"), (F.first("_s") - eps).alias("desviacion")
    )


def block_outliers(tiles: DataFrame, z: float = 3.0) -> DataFrame:
    """Share of tiles whose mean lies more than 3 deviations off."""
    return _share_beyond(tile_moments(tiles), "mean", z, 1e-6)


def variance_outliers(tiles: DataFrame, k: float = 2.0) -> DataFrame:
    """Share of tiles whose variance lies more than 2 deviations off."""
    return _share_beyond(tile_moments(tiles), "var", k, 0.0)


#: tiles of a quadrant whose pixels are run through in reading order; larger quadrants merge the sums of their tiles
QUADRANT_TILES = 1024


def _running_variance(tiles: Column) -> Column:
    """Population variance of sorted (ty, tx, px) by the running rule, value after value."""

    def add(a: Column, v: Column) -> Column:
        n, gap = a["n"] + 1, v.cast("double") - a["m"]
        mean = a["m"] + gap / n
        return F.struct(n.alias("n"), mean.alias("m"), (a["d"] + (v.cast("double") - mean) * gap).alias("d"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))
    return F.aggregate(F.flatten(F.transform(tiles, lambda t: t["px"])), zero, add, lambda a: a["d"] / a["n"])


def quadrant_noise(tiles: DataFrame, limit: float = 1000.0, grid: tuple[int, int] | None = None, most: int = QUADRANT_TILES) -> DataFrame:
    """Spread of the pixel variance over the four quadrants of an image.

    `grid` is the size of the images in tiles (rows, columns); without it an image ends at its last tile, so one whose last tiles are
    missing is halved too early. Quadrants of up to `most` tiles take the running variance in reading order, as databases do, so that
    values rounded later agree to the last digit; larger ones merge the exact sums of their tiles and are never gathered.
    """
    if grid:
        halved = tiles.withColumns({"_y": F.lit(grid[0] / 2), "_x": F.lit(grid[1] / 2)})
    else:
        ends = tiles.groupBy("image_id").agg(((F.max("ty") + 1) / 2).alias("_y"), ((F.max("tx") + 1) / 2).alias("_x"))
        halved = tiles.join(ends, "image_id")
    keys = ["image_id", "_qy", "_qx"]
    own = halved.select("image_id", (F.col("ty") >= F.col("_y")).alias("_qy"), (F.col("tx") >= F.col("_x")).alias("_qx"), "ty", "tx", "px")
    sums = tile_moments(own, keys[1:]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    large = sums.where(F.col("_t") > most).select("image_id", (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("_v"))
    few = own.join(sums.where(F.col("_t") <= most).select(*keys), keys, "left_semi")
    small = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "px"))).alias("_p")).select("image_id", _running_variance(F.col("_p")).alias("_v"))
    spread = F.max("_v") - F.min("_v")
    return small.unionByName(large).groupBy("image_id").agg(spread.alias("diferencia_maxima"), (spread > limit).alias("inconsistente"))


def mad_outliers(metrics: DataFrame, names: Sequence[str] = ("lap_var", "edge_density"), z: float = 2.5) -> DataFrame:
    """Robust outliers of a tile grid: flagged when any metric exceeds 2.5 robust deviations upwards.

    All metrics are ranked together, as counted values written down once: the table itself is read twice, for the counts and for the
    result.
    """
    long = metrics.select("image_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("_m")).select("image_id", "_m.*")
    counted = cut_lineage(long.where(F.col("v").isNotNull()).groupBy("image_id", "metric", "v").agg(F.count(F.lit(1)).alias("c")))
    med = counted_medians(counted, ["image_id", "metric"]).withColumnRenamed("median", "med")
    far = counted.join(med, ["image_id", "metric"]).groupBy("image_id", "metric", F.abs(F.col("v") - F.col("med")).alias("v")).agg(F.sum("c").alias("c"))
    mad = counted_medians(cut_lineage(far), ["image_id", "metric"]).withColumnRenamed("median", "mad")
    pick = lambda c, n: F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"_{c}_{n}")
    wide = med.join(mad, ["image_id", "metric"]).groupBy("image_id").agg(*[pick(c, n) for n in names for c in ("med", "mad")])
    out = metrics.join(wide, "image_id")
    for n in names:
        score = F.when(F.col(f"_mad_{n}") < 1e-9, 0.0).otherwise((F.col(n) - F.col(f"_med_{n}")) * 0.6745 / F.col(f"_mad_{n}"))
        out = out.withColumn(f"z_{n}", score)
    hit = reduce(lambda a, b: a | b, [F.col(f"z_{n}") > z for n in names])
    return out.drop(*[f"_{c}_{n}" for n in names for c in ("med", "mad")]).withColumn("outlier", hit)


# ---------------------------------------------------------------- planes


def plane_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute difference of two planes, tile by tile."""
    right = b.select("image_id", "ty", "tx", F.col("px").alias("_p"))
    diff = F.zip_with("px", "_p", lambda x, y: F.abs(x.cast("int") - y.cast("int")).cast("smallint"))
    return a.join(right, ["image_id", "ty", "tx"]).select("image_id", "ty", "tx", diff.alias("px"))


def pixel_histogram(tiles: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, v, c): at most 256 rows per key."""
    return tiles.select(*keys, F.explode("px").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))


def _rank_value(hist: Column, rank: Column) -> Column:
    """Value at a zero-based rank of a cumulative histogram."""
    return F.get(F.filter(hist, lambda h: h["e"] > rank), F.lit(0))["v"]


def _cumulative(hist: Column) -> Column:
    """Sorted (v, c) pairs with running counts; bounded by the 256 pixel values."""
    folded = F.aggregate(
        hist,
        F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<struct<v: double, e: bigint>>").alias("l")),
        lambda a, h: F.struct(
            (a["t"] + h["c"]).alias("t"), F.array_append(a["l"], F.struct(h["v"].cast("double").alias("v"), (a["t"] + h["c"]).alias("e"))).alias("l")
        ),
    )
    return folded["l"]


def _quantile(cum: Column, n: Column, p: float) -> Column:
    pos = (n - 1) * p
    lo, hi = _rank_value(cum, F.floor(pos)), _rank_value(cum, F.ceil(pos))
    return lo + (hi - lo) * (pos - F.floor(pos))


def plane_diff_stats(diff: DataFrame) -> DataFrame:
    """Mean, deviation, maximum, 95th percentile and shares above thresholds of a difference plane."""
    hist = pixel_histogram(diff)
    g = hist.groupBy("image_id").agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("media"),
        (F.sum(F.col("v").cast("double") * F.col("v") * F.col("c")) / F.sum("c")).alias("_q"),
        F.max("v").alias("maximo"),
        F.array_sort(F.collect_list(F.struct("v", "c"))).alias("_h"),
    )
    g = g.withColumn("desviacion", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.pow("media", 2)))).withColumn("_cum", _cumulative(F.col("_h")))
    g = g.withColumn("mediana", _quantile(F.col("_cum"), F.col("n"), 0.5)).withColumn("p95", _quantile(F.col("_cum"), F.col("n"), 0.95))
    deviations = F.array_sort(F.transform("_h", lambda h: F.struct(F.abs(h["v"] - F.col("mediana")).alias("v"), h["c"].alias("c"))))
    g = g.withColumn("_dev", _cumulative(deviations)).withColumn("mad", _quantile(F.col("_dev"), F.col("n"), 0.5))
    above = lambda t: F.aggregate(F.filter("_h", lambda h: h["v"] > t), F.lit(0).cast("bigint"), lambda a, h: a + h["c"]) / F.col("n")
    robust = F.greatest(F.lit(5.0), F.least(F.lit(255.0), F.col("mediana") + (F.col("mad") + 1e-6) * 3 * 1.4826))
    return g.withColumn("umbral_robusto", robust).select(
        "image_id", "n", "media", "desviacion", "maximo", "p95", "mediana", "mad", "umbral_robusto",
        above(F.col("media") + F.col("desviacion") * 2).alias("sobre_2s"),
        above(F.col("media") + F.col("desviacion") * 3).alias("sobre_3s"),
        above(F.col("umbral_robusto")).alias("sobre_robusto"),
    )


def diff_level(stats: DataFrame) -> DataFrame:
    """Editing verdict from the share above mean + 3 deviations and an edge density (0 when unknown)."""
    if "densidad_bordes" not in stats.columns:
        stats = stats.withColumn("densidad_bordes", F.lit(0.0))
    pct, edge = F.col("sobre_3s") * 100, F.col("densidad_bordes")
    level = (
        F.when((pct > 25) | (edge > 0.25), "ALTO").when((pct > 15) | (edge > 0.18), "MEDIO").when((pct > 8) | (edge > 0.13), "BAJO").otherwise("NORMAL")
    )
    edited = ((pct > 8) & (edge > 0.12)) | (pct > 15) | (edge > 0.13)
    return stats.select("image_id", pct.alias("porcentaje"), edited.alias("tiene_ediciones"), level.alias("nivel"))


def edge_ratio(diff: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean difference on smooth pixels over that on edge pixels (upper quarter of the edge plane)."""
    e = edges.select("image_id", "ty", "tx", F.col("px").alias("_e"))
    pixels = diff.join(e, ["image_id", "ty", "tx"]).select("image_id", F.explode(F.arrays_zip("px", "_e")).alias("_z"))
    joint = pixels.groupBy("image_id", F.col("_z._e").alias("e")).agg(F.count(F.lit(1)).alias("c"), F.sum("_z.px").alias("s"))
    hist = joint.groupBy("image_id").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("e").alias("v"), "c"))).alias("_h"))
    thr = hist.select("image_id", _quantile(_cumulative(F.col("_h")), F.col("n"), 0.75).alias("_t"))
    side = lambda test, c: F.sum(F.when(test, F.col(c)))
    on, off = F.col("e") >= F.col("_t"), F.col("e") < F.col("_t")
    g = joint.join(thr, "image_id").groupBy("image_id").agg(
        (side(on, "s") / side(on, "c")).alias("_on"), (side(off, "s") / side(off, "c")).alias("_off"), (F.sum("s") / F.sum("c")).alias("_all")
    )
    edge, smooth = F.coalesce("_on", "_all"), F.coalesce("_off", "_all")
    return g.select("image_id", edge.alias("media_bordes"), smooth.alias("media_lisa"), ((smooth + 1e-6) / (edge + 1e-6)).alias("razon"))


def quality_slope(plane_means: DataFrame) -> DataFrame:
    """Slope of the mean difference over 100 - quality, and the quality that changes least."""
    return plane_means.groupBy("image_id").agg(
        F.regr_slope("media", (100 - F.col("q")).cast("double")).alias("pendiente"), F.min_by("q", F.struct("media", "q")).alias("calidad_probable")
    )


def diff_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of pixels that differ between two renders."""
    d = plane_diff(a, b)
    return d.groupBy("image_id").agg((F.sum(F.size(F.filter("px", lambda v: v > 0))) / F.sum(F.size("px"))).alias("proporcion"))


def grey_entropy(tiles: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Entropy in bits and in nats, and grey levels that hold over 1% of the pixels."""
    hist = pixel_histogram(tiles, keys)
    total = hist.groupBy(*keys).agg(F.sum("c").alias("_n"))
    p = F.col("c") / F.col("_n")
    return hist.join(total, list(keys)).groupBy(*keys).agg(
        (-F.sum(p * F.log2(p))).alias("bits"), (-F.sum(p * F.log(p))).alias("nats"), F.count_if(p > 0.01).alias("dominantes")
    )


def gradient_shares(tiles: DataFrame, width: int) -> DataFrame:
    """Shares of steep pixel steps in both directions; steps across tile borders included.

    `width` is the tile side. Inside a tile the steps come from the array; the first column and row
    of the right and lower neighbours supply the rest.
    """
    n = width * width
    cells = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda i: F.element_at("px", i + 1).cast("int")
    dx = F.transform(F.filter(cells, lambda i: i % width < width - 1), lambda i: F.abs(at(i + 1) - at(i)))
    dy = F.transform(F.filter(cells, lambda i: i < n - width), lambda i: F.abs(at(i + width) - at(i)))
    col = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda r: at(r * width + c))
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: at(c + r * width))
    t = tiles.select(
        "image_id", "ty", "tx", dx.alias("dx"), dy.alias("dy"), col(width - 1).alias("_r"), row(width - 1).alias("_b"), col(0).alias("_l"), row(0).alias("_t")
    )
    right = t.select("image_id", "ty", (F.col("tx") - 1).alias("tx"), F.col("_l").alias("_nr"))
    below = t.select("image_id", (F.col("ty") - 1).alias("ty"), "tx", F.col("_t").alias("_nb"))
    joined = t.join(right, ["image_id", "ty", "tx"], "left").join(below, ["image_id", "ty", "tx"], "left")
    step = lambda a, b: F.coalesce(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.array().cast("array<int>"))
    every = joined.select("image_id", F.concat("dx", step("_r", "_nr")).alias("dx"), F.concat("dy", step("_b", "_nb")).alias("dy"))
    over = lambda c, k: F.sum(F.size(F.filter(c, lambda v: v > k))) / F.sum(F.size(c))
    g = every.groupBy("image_id").agg(over("dx", 50).alias("dx50"), over("dy", 50).alias("dy50"), over("dx", 30).alias("dx30"), over("dy", 30).alias("dy30"))
    return g.withColumn("bordes_rectos", (F.col("dx50") > 0.1) | (F.col("dy50") > 0.1)).withColumn(
        "patron_texto", (F.col("dx30") > 0.05) | (F.col("dy30") > 0.05)
    )


# ---------------------------------------------------------------- block grid


def grid_discontinuity(tiles: DataFrame, size: int = 8, wrap8: bool = True) -> DataFrame:
    """Breaks of the first-pixel sequence along block rows and columns, and clustered rough blocks.

    `wrap8` takes differences modulo 256, as 8-bit arithmetic does. Neighbours meet by an equi-join
    on the block position, so a row of any length is spread over tasks.
    """
    b = tile_moments(tiles).select("image_id", "ty", "tx", "var").join(
        tiles.select("image_id", "ty", "tx", F.element_at("px", 1).cast("int").alias("dc")), ["image_id", "ty", "tx"]
    )

    def breaks(line: str, step: str) -> DataFrame:
        nxt = b.select("image_id", line, (F.col(step) - 1).alias(step), F.col("dc").alias("_n"))
        raw = F.col("_n") - F.col("dc")
        d = F.pmod(raw, F.lit(256)) if wrap8 else raw
        per_line = b.join(nxt, ["image_id", line, step]).groupBy("image_id", line).agg(F.stddev_pop(d).alias("_sd"), F.avg(F.abs(d)).alias("_ma"))
        return per_line.groupBy("image_id").agg(F.count_if(F.col("_sd") > F.col("_ma") * 2).alias(f"cortes_{line}"))

    mean = b.groupBy("image_id").agg(F.avg("var").alias("_mv"), F.count(F.lit(1)).alias("bloques"), (F.max("tx") + 1).alias("_w"))
    rough = b.join(mean, "image_id").where(F.col("var") > F.col("_mv") * 3)
    count = rough.groupBy("image_id").agg(F.count(F.lit(1)).alias("rugosos"))
    spaced = pair_distance(rough.select("image_id", (F.col("ty") * F.col("_w") + F.col("tx")).cast("bigint").alias("pos"), (F.col("ty") * size).alias("y"), (F.col("tx") * size).alias("x")))
    out = mean.select("image_id", "bloques")
    for part in (breaks("ty", "tx"), breaks("tx", "ty"), count, spaced):
        out = out.join(part, "image_id", "left")
    out = out.fillna(0, ["cortes_ty", "cortes_tx", "rugosos"])
    density = F.col("rugosos") / F.col("bloques")
    total = F.col("cortes_ty") + F.col("cortes_tx")
    local = (F.col("rugosos") > 0) & (density < 0.1)
    grouped = F.coalesce(F.col("distancia_media") < 50, F.lit(False))
    return out.select(
        "image_id", "bloques", F.col("cortes_ty").alias("cortes_filas"), F.col("cortes_tx").alias("cortes_columnas"), "rugosos", density.alias("densidad"),
        local.alias("localizado"), "distancia_media", grouped.alias("agrupado"), ((total > 5) | (local & grouped)).alias("tiene_splicing"),
    )


def _distance_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for image, ca, cb, a, b in zip(batch["image_id"], batch["chunk_a"], batch["chunk_b"], batch["rows_a"], batch["rows_b"]):
            p = np.array([(r["y"], r["x"]) for r in a], dtype=float)
            q = np.array([(r["y"], r["x"]) for r in b], dtype=float)
            d = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))
            if ca == cb:
                d = d[np.triu_indices(len(p), 1)]
            out.append((image, float(d.sum()), int(d.size)))
        yield pd.DataFrame(out, columns=["image_id", "s", "n"])


def pair_distance(points: DataFrame) -> DataFrame:
    """Mean distance over all pairs of an image's points; only sums per chunk pair leave a task."""
    key = points.schema["image_id"].dataType.simpleString()
    pairs = chunk_pairs(pack_chunks(points, ["image_id"], "pos", ["y", "x"], 1024), ["image_id"])
    sums = pairs.mapInPandas(_distance_sums, f"image_id {key}, s double, n bigint")
    return sums.groupBy("image_id").agg(F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")).alias("distancia_media"))


# ---------------------------------------------------------------- double compression

# Low-frequency coefficients examined, as (row, column).
AC_TERMS = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 2)]


def _dct_matrix() -> np.ndarray:
    k, i = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    m = np.cos((2 * i + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def _block_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    m = _dct_matrix()
    for batch in batches:
        if batch.empty:
            continue
        px = np.stack(batch["px"].to_numpy()).astype(float).reshape(-1, 8, 8) - 128.0
        c = m @ px @ m.T
        inner = c[:, 1:, 1:].reshape(len(px), -1)
        cols = {"image_id": batch["image_id"], "dc": c[:, 0, 0], "ac_s": inner.sum(axis=1), "ac_q": (inner**2).sum(axis=1)}
        cols.update({f"ac{i}": c[:, r, k] for i, (r, k) in enumerate(AC_TERMS)})
        yield pd.DataFrame(cols)


def block_terms(tiles: DataFrame) -> DataFrame:
    """Transform coefficients of 8x8 tiles: DC, five AC terms and moments of the inner 49."""
    key = tiles.schema["image_id"].dataType.simpleString()
    terms = ", ".join(f"ac{i} double" for i in range(len(AC_TERMS)))
    return tiles.select("image_id", "px").mapInPandas(_block_terms, f"image_id {key}, dc double, ac_s double, ac_q double, {terms}")


def _spectrum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    smooth = np.array([1, 2, 3, 2, 1]) / 9.0
    for batch in batches:
        out = []
        for image, comp, bins, counts in zip(batch["image_id"], batch["comp"], batch["bins"], batch["counts"]):
            hist = np.zeros(121)
            hist[np.asarray(bins, dtype=int) + 60] = counts
            spec = np.abs(np.fft.rfft(np.convolve(hist, smooth, mode="same")))[1:]
            med = np.median(spec)
            peaks = np.where(spec > med + 6.0 * 1.4826 * (np.median(np.abs(spec - med)) + 1e-6))[0]
            out.append((image, comp, len(peaks), float(peaks[0] + 1) / 121 if len(peaks) else 0.0))
        yield pd.DataFrame(out, columns=["image_id", "comp", "picos", "frecuencia"])


def coefficient_periods(terms: DataFrame) -> DataFrame:
    """Spectral peaks of each coefficient's histogram; 121 counts per image and term reach Python."""
    key = terms.schema["image_id"].dataType.simpleString()
    comps = F.array(*[F.struct(F.lit(i).alias("comp"), F.col(f"ac{i}").alias("v")) for i in range(len(AC_TERMS))])
    binned = F.rint(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("_c.v")))).cast("int")
    hist = terms.select("image_id", F.explode(comps).alias("_c")).groupBy("image_id", F.col("_c.comp").alias("comp"), binned.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    rows = hist.groupBy("image_id", "comp").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("_h")).select(
        "image_id", "comp", F.col("_h.b").alias("bins"), F.col("_h.c").alias("counts")
    )
    return rows.mapInPandas(_spectrum, f"image_id {key}, comp int, picos int, frecuencia double")


def double_compression(tiles: DataFrame) -> DataFrame:
    """Periodic coefficient histograms as a trace of a second compression."""
    terms = block_terms(tiles)
    k = len(AC_TERMS)
    ac = [F.col(f"ac{i}") for i in range(k)]
    n = F.count(F.lit(1))
    total, squares = sum((F.sum(a) for a in ac), F.lit(0.0)), sum((F.sum(a * a) for a in ac), F.lit(0.0))
    var = terms.groupBy("image_id").agg(F.var_pop("dc").alias("dc_variance"), (squares / (n * k) - F.pow(total / (n * k), 2)).alias("ac_variance"))
    p = coefficient_periods(terms).groupBy("image_id").agg(
        F.max("picos").alias("num_picos"), (F.count_if(F.col("picos") >= 3) / F.lit(float(k))).alias("consistencia")
    )
    found = (F.col("consistencia") >= 0.5) & (F.col("num_picos") >= 3)
    grade = F.when(found & (F.col("consistencia") >= 0.6) & (F.col("num_picos") >= 4), "ALTA").when(found, "MEDIA").otherwise("BAJA")
    return p.join(var, "image_id").withColumn("tiene_doble_compresion", found).withColumn("confianza", grade)


def _count_peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for image, bins, counts in zip(batch["image_id"], batch["bins"], batch["counts"]):
            hist = np.zeros(50)
            hist[np.asarray(bins, dtype=int)] = counts
            limit, n, i = hist.max() * 0.1, 0, 1
            # a flat top counts once when both of its sides fall
            while i < 49:
                if hist[i] > hist[i - 1]:
                    j = i
                    while j < 49 and hist[j + 1] == hist[i]:
                        j += 1
                    if j < 49 and hist[j + 1] < hist[i]:
                        n += hist[i] >= limit
                    i = j
                i += 1
            out.append((image, int(n)))
        yield pd.DataFrame(out, columns=["image_id", "picos"])


def double_compression_simple(tiles: DataFrame) -> DataFrame:
    """Plainer traces: peaks of a 50-bin DC histogram, AC against DC variance, DC deviation over 50."""
    key = tiles.schema["image_id"].dataType.simpleString()
    terms = block_terms(tiles)
    n = F.count(F.lit(1))
    g = terms.groupBy("image_id").agg(
        F.min("dc").alias("_lo"), F.max("dc").alias("_hi"), F.var_pop("dc").alias("dc_variance"), F.avg("dc").alias("_m"),
        (F.sum("ac_q") / (n * 49) - F.pow(F.sum("ac_s") / (n * 49), 2)).alias("ac_variance"),
    )
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    slot = F.least(F.lit(49), F.floor((F.col("dc") - lo) / width * 50)).cast("int")
    hist = terms.join(g, "image_id").groupBy("image_id", slot.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    rows = hist.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("_h"))
    peaks = rows.select("image_id", F.col("_h.b").alias("bins"), F.col("_h.c").alias("counts")).mapInPandas(_count_peaks, f"image_id {key}, picos int")
    periodic, high = F.col("picos") > 3, F.col("ac_variance") > F.col("dc_variance") * 2
    return g.join(peaks, "image_id").select(
        "image_id", "picos", "dc_variance", "ac_variance", (F.sqrt("dc_variance") > 50).alias("dc_disperso"), (periodic | high).alias("tiene_doble_compresion"),
        F.when(periodic, "ALTA").when(high, "MEDIA").otherwise("BAJA").alias("confianza"),
    )


# ---------------------------------------------------------------- copies inside an image


def _nearest_two(max_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        popcount = np.array([bin(i).count("1") for i in range(256)], dtype=np.int32)
        for batch in batches:
            out = []
            for image, a, b in zip(batch["image_id"], batch["rows_a"], batch["rows_b"]):
                da = np.array([r["descriptor"] for r in a]).astype(np.uint8)
                db = np.array([r["descriptor"] for r in b]).astype(np.uint8)
                ia = np.array([r["kp_id"] for r in a])
                ib = np.array([r["kp_id"] for r in b])
                dist = np.zeros((len(da), len(db)), dtype=np.int32)
                for byte in range(da.shape[1]):
                    dist += popcount[da[:, byte][:, None] ^ db[:, byte][None, :]]
                dist[ia[:, None] == ib[None, :]] = 1 << 30
                # ties go to the lower id, which is the column order
                order = np.argsort(dist, axis=1, kind="stable")[:, :2]
                for row, cols in enumerate(order):
                    for c in cols:
                        if dist[row, c] < 1 << 30:
                            out.append((image, int(ia[row]), a[row]["x"], a[row]["y"], int(ib[c]), b[c]["x"], b[c]["y"], int(dist[row, c])))
            yield pd.DataFrame(out, columns=["image_id", "q", "qx", "qy", "t", "tx", "ty", "d"])

    return run


def copy_move(keypoints: DataFrame, image_meta: DataFrame, ratio: float = 0.75, min_distance: float = 20.0, min_keypoints: int = 0) -> DataFrame:
    """Repeated regions: nearest other descriptor clearly closer than the next one, and far away.

    Every query keeps two candidates per piece of its image, so a task returns two rows per query
    however large the image is; the best two over all pieces decide.
    """
    key = keypoints.schema["image_id"].dataType.simpleString()
    packed = pack_chunks(keypoints, ["image_id"], "kp_id", ["x", "y", "descriptor"], 512)
    pairs = chunk_pairs(packed, ["image_id"], ordered=True).select("image_id", "rows_a", "rows_b")
    schema = f"image_id {key}, q bigint, qx double, qy double, t bigint, tx double, ty double, d int"
    near = pairs.mapInPandas(_nearest_two(2), schema)
    order = W.partitionBy("image_id", "q").orderBy("d", "t")
    top = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    best = top.groupBy("image_id", "q").agg(
        F.min_by(F.struct("qx", "qy", "t", "tx", "ty", "d"), "_r").alias("m"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2")
    )
    far = F.sqrt(F.pow(F.col("m.qx") - F.col("m.tx"), 2) + F.pow(F.col("m.qy") - F.col("m.ty"), 2)) > min_distance
    good = best.where((F.col("m.d") < F.col("d2") * ratio) & far)
    unordered = good.select("image_id", F.least("q", "m.t").alias("a"), F.greatest("q", "m.t").alias("b")).distinct()
    counts = unordered.groupBy("image_id").agg(F.count(F.lit(1)).alias("_m"))
    kps = keypoints.groupBy("image_id").agg(F.count(F.lit(1)).alias("puntos"))
    out = image_meta.select("image_id", "width", "height").join(kps, "image_id").join(counts, "image_id", "left")
    matches = F.when(F.col("puntos") >= min_keypoints, F.coalesce("_m", F.lit(0))).otherwise(0)
    density = matches / F.greatest(F.lit(1.0), F.col("width") * F.col("height") / 1e6)
    return out.select(
        "image_id", "puntos", matches.cast("bigint").alias("coincidencias"), density.alias("densidad_mpx"), F.least(F.lit(1.0), density / 200.0).alias("puntaje"),
        F.least(F.lit(1.0), matches / 100.0).alias("puntaje_combinado"),
    )


def _correlated(limit: int, min_r: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(rows) -> np.ndarray:
            p = np.array([r["px"] for r in rows], dtype=float)
            p -= p.mean(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                return p / np.sqrt((p**2).sum(axis=1, keepdims=True))

        for batch in batches:
            out = []
            for image, a, b in zip(batch["image_id"], batch["rows_a"], batch["rows_b"]):
                r = unit(a) @ unit(b).T
                ia = np.array([x["patch_no"] for x in a])
                ib = np.array([x["patch_no"] for x in b])
                hit = (r > min_r) & (ia[:, None] < ib[None, :])
                n = int(hit.sum())
                if n:
                    rows, cols = np.nonzero(hit)
                    first = [(int(ia[i]), int(ib[j]), float(r[i, j])) for i, j in list(zip(rows, cols))[:limit]]
                    out.extend((image, n if k == 0 else 0, i, j, c) for k, (i, j, c) in enumerate(first))
            yield pd.DataFrame(out, columns=["image_id", "n", "i", "j", "r"])

    return run


def patch_pairs(patches: DataFrame, min_r: float = 0.8, limit: int = 10) -> DataFrame:
    """Number of strongly correlated patch pairs per image, with the first ten of them.

    patches: (image_id, patch_no, px). Pairs are counted inside the task that compares two pieces;
    only the counts and at most ten examples per piece leave it. Uniform patches never match.
    """
    key = patches.schema["image_id"].dataType.simpleString()
    packed = pack_chunks(patches, ["image_id"], "patch_no", ["px"], 256)
    pairs = chunk_pairs(packed, ["image_id"]).select("image_id", "rows_a", "rows_b")
    found = pairs.mapInPandas(_correlated(limit, min_r), f"image_id {key}, n bigint, i bigint, j bigint, r double")
    total = found.groupBy("image_id").agg(F.sum("n").alias("pares"))
    order = W.partitionBy("image_id").orderBy("i", "j")
    first = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    return first.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "r"))).alias("ejemplos")).join(total, "image_id")


def regional_ssim(tiles: DataFrame) -> DataFrame:
    """Similarity of every region with its right and lower neighbour, one window per region."""
    n = F.size("px")
    t = tile_moments(tiles).select("image_id", "ty", "tx", "mean", "var").join(tiles.select("image_id", "ty", "tx", "px"), ["image_id", "ty", "tx"])
    right = t.select("image_id", "ty", (F.col("tx") - 1).alias("tx"), *[F.col(c).alias(f"_{c}") for c in ("mean", "var", "px")])
    below = t.select("image_id", (F.col("ty") - 1).alias("ty"), "tx", *[F.col(c).alias(f"_{c}") for c in ("mean", "var", "px")])
    pairs = t.join(right.unionByName(below), ["image_id", "ty", "tx"])
    dot = F.aggregate(F.zip_with("px", "_px", lambda a, b: a.cast("bigint") * b), F.lit(0).cast("bigint"), lambda s, v: s + v)
    cov = dot / n - F.col("mean") * F.col("_mean")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = ((F.col("mean") * F.col("_mean") * 2 + c1) * (cov * 2 + c2)) / (
        (F.pow("mean", 2) + F.pow("_mean", 2) + c1) * (F.col("var") + F.col("_var") + c2)
    )
    v = pairs.select("image_id", ssim.alias("s"))
    g = v.groupBy("image_id").agg(F.count(F.lit(1)).alias("comparaciones"), F.avg("s").alias("media"), F.stddev_pop("s").alias("desviacion"), F.min("s").alias("minimo"))
    low = v.join(g, "image_id").groupBy("image_id").agg(F.avg((F.col("s") < F.col("media") - F.col("desviacion") * 2).cast("double")).alias("proporcion_baja"))
    p = F.col("proporcion_baja")
    return g.join(low, "image_id").withColumn("inconsistente", p > 0.1).withColumn("nivel", F.when(p > 0.2, "ALTO").when(p > 0.1, "MEDIO").otherwise("BAJO"))
