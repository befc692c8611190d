"""Joins of boxes on a page: overlaps, covers, labels and their amounts; layout statistics.

Boxes meet through the cells of a grid of several levels: a box belongs to the level whose cells are as large as it, so it touches a
few cells however large it is, and is looked up in the coarser levels that occur. A cell with many boxes is dealt to several tasks. A
pair that shares several cells is kept only in the cell that holds the lower corner of its intersection, so no de-duplication step is
needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.functions.binding import let
from cotejo.functions.numbers import clean_amount
from cotejo.functions.text import extract_all
from cotejo.session import cut_lineage
from cotejo.skew import bounded_broadcast, chunked_lag, spread

BOX = ("x0", "y0", "x1", "y1")
# Image filters that count as standard.
STANDARD_FILTERS = [
    "DCTDecode", "FlateDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "RunLengthDecode", "LZWDecode",
]


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


#: boxes of one cell that one task compares with those of the other table
CROWD = 4096
_MOST_LEVELS = 60


def _leveled(df: DataFrame, p: str, cell: float) -> DataFrame:
    """With `_own`, the level whose cells are as large as the box."""
    side = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(cell)) / cell
    return df.withColumn("_own", F.least(F.ceil(F.log2(side)), F.lit(_MOST_LEVELS)).cast("int"))


def _in_cells(df: DataFrame, p: str, cell: float, levels: Column) -> DataFrame:
    """One row for every cell that a box touches in its own level and in the coarser ones that occur: `_level`, `_cell`."""
    rows = df.withColumn("_level", F.explode(levels)).where(F.col("_level") >= F.col("_own"))
    size = F.pow(F.lit(2.0), F.col("_level")) * cell
    span = lambda a, b: F.sequence(F.floor(F.col(p + a) / size), F.floor(F.greatest(F.col(p + a), F.col(p + b)) / size))
    both = F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    return rows.withColumn("_cell", F.explode(both))


def _met_in_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float, crowd: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables by cells, and the columns to join on. Crowded cells of `b` are dealt by hash, with those of `a` in each part.

    Only the pages of more than `crowd` boxes can hold such a cell. Cells are counted on these pages alone, and where there are none the
    boxes go straight into the join.
    """
    left, right = _leveled(_prefixed(a, keys, "a_"), "a_", cell), _leveled(_prefixed(b, keys, "b_"), "b_", cell)
    levels = left.select("_own").unionByName(right.select("_own")).agg(F.collect_set("_own").alias("l")).scalar()
    pages = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*keys)
    at = [*keys, "_level", "_cell"]
    crowded = not pages.isEmpty()
    heavy = right.join(pages, list(keys), "left_semi") if crowded else None
    left, right = _in_cells(left, "a_", cell, levels).withColumnRenamed("_own", "_a"), _in_cells(right, "b_", cell, levels).withColumnRenamed("_own", "_b")
    if not crowded:
        return left, right, at
    full = _in_cells(heavy, "b_", cell, levels).groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
    full = bounded_broadcast(cut_lineage(full.withColumn("_n", F.ceil(F.col("_n") / crowd).cast("int"))))
    parts = F.coalesce("_n", F.lit(1))
    mine = [c for c in right.columns if c.startswith("b_")]
    right = right.join(full, at, "left").withColumn("_part", F.pmod(F.xxhash64(*mine), parts).cast("int")).drop("_n")
    left = left.join(full, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    return left, right, [*at, "_part"]


def box_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = 64.0, crowd: int = CROWD) -> DataFrame:
    """Pairs of touching boxes of two tables that agree on `keys`; columns prefixed a_ and b_."""
    left, right, at = _met_in_cells(a, b, keys, cell, crowd)
    corner = lambda axis: F.floor(F.greatest(F.col(f"a_{axis}0"), F.col(f"b_{axis}0")) / (F.pow(F.lit(2.0), F.col("_level")) * cell))
    touching = (
        (F.col("a_x0") <= F.col("b_x1"))
        & (F.col("b_x0") <= F.col("a_x1"))
        & (F.col("a_y0") <= F.col("b_y1"))
        & (F.col("b_y0") <= F.col("a_y1"))
    )
    level = F.col("_level") == F.greatest("_a", "_b")
    home = (F.col("_cell.cx") == corner("x")) & (F.col("_cell.cy") == corner("y"))
    return left.join(right, at).where(touching & home & level).drop("_cell", "_level", "_part", "_a", "_b")


def box_semi(a: DataFrame, b: DataFrame, keys: Sequence[str], test: Column, cell: float = 64.0, crowd: int = CROWD) -> DataFrame:
    """Boxes of `a` for which some box of `b` passes the test; a semi-join, so pairs are never formed.

    A passing pair must touch, hence it shares a cell; the same box found through two cells is one.
    """
    left, right, at = _met_in_cells(a, b, keys, cell, crowd)
    same = test & (F.col("_level") == F.greatest("_a", "_b"))
    right = right.withColumnsRenamed({c: f"_r{c}" for c in at})
    for c in at:
        same = same & (F.col(c) == F.col(f"_r{c}"))
    return left.join(right, same, "left_semi").drop("_cell", "_level", "_part", "_a").distinct()


def _inter(axis: str) -> Column:
    return F.least(F.col(f"a_{axis}1"), F.col(f"b_{axis}1")) - F.greatest(F.col(f"a_{axis}0"), F.col(f"b_{axis}0"))


def _area(p: str) -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def iou() -> Column:
    """Intersection over union of the a_ and b_ boxes."""
    inter = F.greatest(F.lit(0.0), _inter("x")) * F.greatest(F.lit(0.0), _inter("y"))
    return F.when(inter > 0, inter / (_area("a_") + _area("b_") - inter)).otherwise(0.0)


def strictly_overlapping() -> Column:
    return (_inter("x") > 0) & (_inter("y") > 0)


def word_overlaps(words: DataFrame, share: float = 0.5, cell: float = 32.0, crowd: int = CROWD) -> DataFrame:
    """Words of one row whose horizontal overlap exceeds half their mean width.

    A row is the top rounded to one decimal, so it is part of the join key together with the
    horizontal cell.
    """
    none = F.lit(0.0)
    rowed = words.select("doc_id", "page", F.bround("y0", 1).alias("fila"), "word_no", "x0", "x1", none.alias("y0"), none.alias("y1"), "text")
    keys = ["doc_id", "page", "fila"]
    overlap = F.greatest(F.lit(0.0), _inter("x"))
    width = (F.col("a_x1") - F.col("a_x0") + F.col("b_x1") - F.col("b_x0")) / 2
    found = box_pairs(rowed, rowed, keys, cell, crowd).where((F.col("a_word_no") < F.col("b_word_no")) & (overlap > width * share))
    return found.select(*keys, "a_word_no", "b_word_no", "a_text", "b_text", F.round(overlap, 2).alias("solapamiento"))


def overlap_summary(words: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Cases per document with affected pages and words analysed."""
    n = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("palabras"), F.count_distinct("page").alias("paginas"))
    c = overlaps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("casos"), F.count_distinct("page").alias("paginas_afectadas"))
    out = n.join(c, "doc_id", "left").fillna(0, ["casos", "paginas_afectadas"])
    return out.withColumn("detectado", F.col("casos") > 0)


def block_overlaps(blocks: DataFrame, min_area: float = 0.0, cell: float = 64.0) -> DataFrame:
    """Overlapping pairs of text blocks per page; only the counts leave the join."""
    text = blocks.where(F.col("type") == 0).select("doc_id", "page", "block_no", *BOX)
    pairs = box_pairs(text, text, ["doc_id", "page"], cell).where((F.col("a_block_no") < F.col("b_block_no")) & strictly_overlapping())
    if min_area > 0:
        pairs = pairs.where(_inter("x") * _inter("y") > min_area)
    return pairs.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("solapes"))


def covering_boxes(blocks: DataFrame, drawings: DataFrame, min_iou: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Images and filled shapes that cover a text block."""
    text = blocks.where(F.col("type") == 0).select("doc_id", "page", *BOX)
    images = blocks.where(F.col("type") == 1).select("doc_id", "page", F.lit("image").alias("kind"), F.col("block_no").alias("no"), *BOX)
    shapes = drawings.where(F.col("filled")).select("doc_id", "page", F.lit("shape").alias("kind"), F.col("draw_no").alias("no"), *BOX)
    hits = box_semi(images.unionByName(shapes), text, ["doc_id", "page"], iou() > min_iou, cell)
    return hits.select("doc_id", "page", F.col("a_kind").alias("kind"), F.col("a_no").alias("no"))


def overlapping_annots(annots: DataFrame, blocks: DataFrame, cell: float = 64.0) -> DataFrame:
    """Annotations that lie over a text block."""
    a = annots.select("doc_id", "page", "annot_no", *BOX)
    text = blocks.where(F.col("type") == 0).select("doc_id", "page", *BOX)
    hits = box_semi(a, text, ["doc_id", "page"], strictly_overlapping(), cell)
    return hits.select("doc_id", "page", F.col("a_annot_no").alias("annot_no")).distinct()


def token_boxes(tokens: DataFrame) -> DataFrame:
    """left/top/width/height to corner form."""
    return tokens.withColumns(
        {
            "x0": F.col("left").cast("double"),
            "y0": F.col("top").cast("double"),
            "x1": (F.col("left") + F.col("width")).cast("double"),
            "y1": (F.col("top") + F.col("height")).cast("double"),
        }
    )


def tokens_for_boxes(boxes: DataFrame, tokens: DataFrame, min_iou: float = 0.4, cell: float = 64.0) -> DataFrame:
    """First recognised token that matches a box: (image_id, box_no, text, es_numerico)."""
    t = token_boxes(tokens).select("image_id", "token_no", "text", *BOX)
    hits = box_pairs(boxes.select("image_id", "box_no", *BOX), t, ["image_id"], cell).where(iou() > min_iou)
    first = hits.groupBy("image_id", F.col("a_box_no").alias("box_no")).agg(F.min_by("b_text", "b_token_no").alias("text"))
    return first.withColumn("es_numerico", F.coalesce(F.col("text").rlike(r"^[0-9.,/:-]+$"), F.lit(False)))


def clusters_on_text(clusters: DataFrame, tokens: DataFrame, cell: float = 64.0) -> DataFrame:
    """Per image and cluster: text under it, and digits in text of two or more characters."""
    t = token_boxes(tokens).select("image_id", "text", *BOX)
    hits = box_pairs(clusters.select("image_id", "cluster_id", *BOX), t, ["image_id"], cell).where(strictly_overlapping())
    digits = F.col("b_text").rlike(r"\d") & (F.length("b_text") >= 2)
    return hits.groupBy("image_id", F.col("a_cluster_id").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("cajas_texto"), F.bool_or(F.coalesce(digits, F.lit(False))).alias("con_digitos")
    )


def localized(boxes: DataFrame, distance: float = 60.0) -> DataFrame:
    """Is any suspicious box within 60 px of another?

    Centres fall into cells whose diagonal is that distance: two in one cell settle the question by
    a count. Only images without such a cell compare neighbouring cells, and those hold one box each,
    so crowded images never form pairs.
    """
    side = distance / 2**0.5
    c = boxes.select("image_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    cells = c.groupBy("image_id", F.floor(F.col("cx") / side).alias("gx"), F.floor(F.col("cy") / side).alias("gy")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("cx").alias("cx"), F.first("cy").alias("cy")
    )
    images = cells.groupBy("image_id").agg((F.max("_n") > 1).alias("_dense"))
    single = cells.join(images.where(~F.col("_dense")).select("image_id"), "image_id", "left_semi")
    # half of the neighbourhood: each pair of cells meets once
    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    near = single.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))).select(
        "image_id", (F.col("gx") + F.col("_s.dx")).alias("gx"), (F.col("gy") + F.col("_s.dy")).alias("gy"), F.col("cx").alias("_x"), F.col("cy").alias("_y")
    )
    close = F.pow(F.col("cx") - F.col("_x"), 2) + F.pow(F.col("cy") - F.col("_y"), 2) < distance * distance
    found = single.join(near, ["image_id", "gx", "gy"]).where(close).select("image_id", F.lit(True).alias("_near")).distinct()
    out = images.join(found, "image_id", "left")
    return out.select("image_id", (F.col("_dense") | F.coalesce("_near", F.lit(False))).alias("localizado"))


# ---------------------------------------------------------------- amounts beside labels

# Label texts and their priorities.
TOTAL_LABELS = [
    ("VALOR TOTAL", 100), ("IMPORTE TOTAL", 100), ("TOTAL A PAGAR", 90), ("TOTAL GENERAL", 90), ("VALOR TO", 80),
    ("IMPORTE TO", 80), ("TOTAL TO", 80), ("VALOR T", 70), ("IMPORTE T", 70),
]
# A number with or without thousands marks, whole.
_NUMBER = r"((?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{2})?)(?!\d)"


def label_amounts(words: DataFrame, tolerance: float = 5.0, minimum: float = 0.0) -> DataFrame:
    """Grand total of a page layout: the rightmost amount on the band of the best label.

    Labels of priority 90 and up displace weaker ones; equal priority goes to the smaller x. Without
    any label hit the largest number of the document is taken.
    """
    priority = None
    for text, p in TOTAL_LABELS:
        test = F.upper("text").contains(text)
        priority = F.when(test, p) if priority is None else priority.when(test, p)
    yc = (F.col("y0") + F.col("y1")) / 2
    values = F.transform(extract_all(F.col("text"), _NUMBER, 1), lambda v: clean_amount(v))
    amounts = (
        words.select("doc_id", "page", "word_no", F.col("x0").alias("_x"), yc.alias("_yc"), F.posexplode(values).alias("_k", "valor"))
        .where(F.col("valor") >= minimum)
        .withColumn("_band", F.floor(F.col("_yc") / tolerance))
    )
    labels = (
        words.select("doc_id", "page", F.col("word_no").alias("_label"), yc.alias("_ly"), priority.alias("_p"))
        .where(F.col("_p").isNotNull())
        .withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_ly") / tolerance) + d)))
    )
    beside = labels.join(amounts, ["doc_id", "page", "_band"]).where(F.abs(F.col("_yc") - F.col("_ly")) <= tolerance)
    per_label = beside.groupBy("doc_id", "page", "_label", "_p").agg(
        F.max_by(F.struct("valor", "_x"), F.struct(F.col("_x"), -F.col("word_no"), -F.col("_k"))).alias("_a")
    )
    best = per_label.groupBy("doc_id").agg(
        F.min_by(F.col("_a.valor"), F.struct(-F.col("_p"), F.col("_a._x"), F.col("page"), F.col("_label"))).alias("_best")
    )
    largest = words.select("doc_id", F.array_max(F.filter(values, lambda v: v >= minimum)).alias("_v")).groupBy("doc_id").agg(F.max("_v").alias("_max"))
    out = largest.join(best, "doc_id", "left")
    method = F.when(F.col("_best").isNotNull(), "busqueda_espacial").when(F.col("_max").isNotNull(), "busqueda_texto_fallback")
    return out.select("doc_id", F.coalesce("_best", "_max").alias("valor_total"), method.otherwise("no_encontrado").alias("metodo"))


_WORD_NUMBER = r"^[-+]?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{2})?$"


def label_amounts_in_band(words: DataFrame, labels: DataFrame, doc_text: DataFrame, margin: float = 3.0, cell: float = 24.0) -> DataFrame:
    """Variant with labels found as phrases: rightmost number to the right in the band of the label.

    labels: (doc_id, page, label_no, x0..y1) in search order. A band that reads "SIN SUBSIDIO" is
    skipped. Without a hit, the first labelled number of the text is taken.
    """
    band = labels.select(
        "doc_id", "page", "label_no", F.col("x1").alias("_lx"), (F.col("y0") - margin).alias("_t"), (F.col("y1") + margin).alias("_b")
    ).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_t") / cell), F.floor(F.col("_b") / cell))))
    w = words.select("doc_id", "page", "word_no", "x0", "y0", "y1", "text").withColumn(
        "_c", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.greatest("y0", "y1") / cell)))
    )
    home = F.col("_c") == F.floor(F.greatest("y0", "_t") / cell)
    inside = band.join(w, ["doc_id", "page", "_c"]).where((F.col("y0") <= F.col("_b")) & (F.col("y1") >= F.col("_t")) & home)
    keys = ["doc_id", "page", "label_no"]
    # words of the band in reading order: a pair split over two words also spells the exclusion
    # only bands with the second word can spell it
    named = inside.where(F.col("text").rlike("(?i)SUBSIDIO")).select(*keys).distinct()
    spelled = chunked_lag(inside.select(*keys, "word_no", "text").join(named, keys, "left_semi"), keys, "word_no", F.floor(F.col("word_no") / 4096), ["text"])
    two = F.concat_ws(" ", F.coalesce("prev_text", F.lit("")), "text")
    excluded = spelled.where(two.rlike(r"(?i)SIN\s+SUBSIDIO")).select(*keys).distinct()
    right = inside.where((F.col("x0") > F.col("_lx") - 1) & F.col("text").rlike(_WORD_NUMBER))
    hits = right.join(excluded, keys, "left_anti").groupBy(*keys).agg(F.max_by("text", F.struct("x0", "word_no")).alias("_raw"))
    value = clean_amount(F.col("_raw"), "mixed")
    spatial = hits.where(value.isNotNull()).groupBy("doc_id").agg(F.min_by(value, F.struct("page", "label_no")).alias("_v"))
    phrase = r"(?is)(?:VALOR\s+TOTAL|IMPORTE\s+TOTAL|TOTAL\s+A\s+PAGAR)[^\d]{0,80}[0-9.,]{1,20}"
    tries = F.filter(extract_all(F.col("text"), phrase), lambda m: ~m.rlike(r"(?i)SIN\s+SUBSIDIO"))
    numbers = F.filter(
        F.transform(tries, lambda m: clean_amount(F.regexp_extract(m, r"([0-9.,]{1,20})$", 1), "mixed")), lambda v: v.isNotNull()
    )
    text = doc_text.select("doc_id", F.get(numbers, F.lit(0)).alias("_t"))
    out = words.select("doc_id").distinct().join(spatial, "doc_id", "left").join(text, "doc_id", "left")
    method = F.when(F.col("_v").isNotNull(), "busqueda_espacial").when(F.col("_t").isNotNull(), "busqueda_texto_fallback")
    return out.select("doc_id", F.coalesce("_v", "_t").alias("valor_total"), method.otherwise("no_encontrado").alias("metodo"))


# ---------------------------------------------------------------- layout statistics


def font_stats(spans: DataFrame) -> DataFrame:
    """Different fonts, spans and share of the most frequent font."""
    per_font = spans.where(F.coalesce("font", F.lit("")) != "").groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("_n"))
    return per_font.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("fuentes"), F.sum("_n").alias("spans"), F.round(F.max("_n") / F.sum("_n"), 3).alias("dominante")
    )


def alignment(spans: DataFrame) -> DataFrame:
    """Mean over pages of the share of lines on the two main left margins, and of slanted lines."""
    margins = (
        spans.where(F.col("origin_x").isNotNull())
        .groupBy("doc_id", "page", F.bround("origin_x", 1).alias("_m"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # the two largest counts by a bounded top-k; ties do not matter for their sum
    order = W.partitionBy("doc_id", "page").orderBy(F.desc("_n"), "_m")
    top = margins.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2).groupBy("doc_id", "page").agg(F.sum("_n").alias("_top"))
    total = margins.groupBy("doc_id", "page").agg(F.sum("_n").alias("_all"))
    slanted = (F.abs(F.col("dir_x") - 1.0) > 0.05) | (F.abs(F.col("dir_y")) > 0.05)
    dirs = spans.groupBy("doc_id", "page").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("dir_x").isNotNull() & F.col("dir_y").isNotNull(), slanted.cast("double"))), 3), F.lit(0.0)).alias("_rot")
    )
    pages = dirs.join(top, ["doc_id", "page"], "left").join(total, ["doc_id", "page"], "left")
    score = F.coalesce(F.round(F.col("_top") / F.col("_all"), 3), F.lit(1.0))
    return pages.groupBy("doc_id").agg(F.avg(score).alias("alineacion"), F.avg("_rot").alias("rotacion"), F.sum("_all").alias("lineas"))


def dpi_stats(pdf_images: DataFrame) -> DataFrame:
    """Resolution of placed images: lowest, highest, mean and population deviation."""
    side = lambda a, b: F.greatest(F.lit(1e-6), F.col(b) - F.col(a))
    dpi = (F.col("w_px") * 72.0 / side("x0", "x1") + F.col("h_px") * 72.0 / side("y0", "y1")) / 2.0
    return pdf_images.where(F.col("x0").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("imagenes"),
        F.round(F.min(dpi), 1).alias("dpi_min"),
        F.round(F.max(dpi), 1).alias("dpi_max"),
        F.round(F.avg(dpi), 1).alias("dpi_media"),
        F.when(F.count(F.lit(1)) > 1, F.round(F.stddev_pop(dpi), 1)).alias("dpi_desviacion"),
    )


def unknown_filters(pdf_images: DataFrame) -> DataFrame:
    """Compression names outside the standard set."""
    tokens = F.array_except(F.split("filters", r"[,\s]+"), F.array(F.lit(""), *[F.lit(f) for f in STANDARD_FILTERS]))
    return pdf_images.select("doc_id", F.explode(tokens).alias("filtro")).distinct()


# ---------------------------------------------------------------- greedy merge


#: counters of the first count of boxes by image
_SLOTS = 1 << 20


def _crowded(boxes: DataFrame, keys: Sequence[str], crowd: int) -> DataFrame | None:
    """Keys of more than `crowd` rows, or None. Rows are counted by a hash of the key first, and one by one only where that many share it."""
    slotted = boxes.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(_SLOTS)).alias("_slot"))
    full = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("_slot")
    if full.isEmpty():
        return None
    found = slotted.join(bounded_broadcast(full), "_slot", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
    found = cut_lineage(found.select(*keys))
    return None if found.isEmpty() else bounded_broadcast(found)


def merge_boxes(boxes: DataFrame, min_iou: float = 0.2, cell: float = 64.0, crowd: int = CROWD, in_pieces: bool = False) -> DataFrame:
    """Boxes kept by the greedy merge: in order of y + 0.1 x a box stays unless a kept one covers it.

    Boxes of an image meet in one row, for which they are shuffled once. Images of more than `crowd` boxes are merged in rounds that are
    spread over the cluster. A box may come `in_pieces`, rows of one number, whose hull it is.
    """
    if in_pieces:
        hull = [F.min(c).alias(c) for c in BOX[:2]] + [F.max(c).alias(c) for c in BOX[2:]]
        whole = lambda b: b.groupBy("image_id", "box_no").agg(*hull)
    else:
        whole = lambda b: b
    boxes = boxes.where(F.col("image_id").isNotNull())
    crowded = _crowded(boxes, ["image_id"], crowd)
    if crowded is None:
        return _merged_in_rows(whole(spread(boxes, ["image_id"])), min_iou)
    few = whole(spread(boxes.join(crowded, "image_id", "left_anti"), ["image_id"]))
    return _merged_in_rows(few, min_iou).unionByName(_merged_in_rounds(whole(boxes.join(crowded, "image_id", "left_semi")), min_iou, cell))


def _merged_in_rows(boxes: DataFrame, min_iou: float) -> DataFrame:
    """The greedy merge as a fold over the sorted boxes of an image.

    Next to the kept boxes the state has those of them that reach below the tops still to come: with x up to m, a box of order o or later
    starts at o - 0.1 m or lower.
    """
    columns = [F.col(c) for c in boxes.columns if c not in ("image_id", "box_no")]
    packed = F.sort_array(F.collect_list(F.struct((F.col("y0") + F.col("x0") * 0.1).alias("_o"), "box_no", *columns)))
    images = boxes.groupBy("image_id").agg(packed.alias("_b"), F.max("x0").alias("_m"))
    side = lambda k, b, axis: F.greatest(F.lit(0.0), F.least(k[f"{axis}1"], b[f"{axis}1"]) - F.greatest(k[f"{axis}0"], b[f"{axis}0"]))
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    covers = lambda k, b: let(side(k, b, "x") * side(k, b, "y"), lambda i: i > min_iou * (area(k) + area(b) - i + 1e-6))

    def step(state: Column, b: Column) -> Column:
        # a little lower, for what rounding takes; unknown where the number is not finite
        top = b["_o"] - F.col("_m") * 0.1 - (F.abs(b["_o"]) + F.abs("_m") + 1) * 1e-9
        low = F.coalesce(F.nanvl(top, F.lit(float("-inf"))), F.lit(float("-inf")))
        live = F.filter(state["live"], lambda k: F.coalesce(k["y1"] > low, F.lit(True)))
        covered = F.coalesce(F.exists(live, lambda k: covers(k, b)), F.lit(False))
        return F.when(covered, state).otherwise(F.struct(F.array_append(state["kept"], b).alias("kept"), F.array_append(live, b).alias("live")))

    kind = images.schema["_b"].dataType.simpleString()
    none = F.array().cast(kind)
    kept = F.aggregate("_b", F.struct(none.alias("kept"), none.alias("live")), step, lambda state: state["kept"])
    return images.select("image_id", F.explode(kept).alias("_k")).select(*[F.col("image_id") if c == "image_id" else F.col("_k")[c].alias(c) for c in boxes.columns])


def _merged_in_rounds(boxes: DataFrame, min_iou: float, cell: float) -> DataFrame:
    """The greedy merge of all boxes at once, spread over the cluster in rounds: a box with no undecided earlier neighbour is decided now
    (kept, or dropped when a kept one covers it). Chains of overlaps settle one link per round, so the number of rounds is the longest
    chain of decisions, not the number of boxes.
    """
    b = boxes.select("image_id", "box_no", *BOX, (F.col("y0") + F.col("x0") * 0.1).alias("_o"))
    inter = F.greatest(F.lit(0.0), _inter("x")) * F.greatest(F.lit(0.0), _inter("y"))
    over = inter > min_iou * (_area("a_") + _area("b_") - inter + 1e-6)
    earlier = (F.col("a__o") < F.col("b__o")) | ((F.col("a__o") == F.col("b__o")) & (F.col("a_box_no") < F.col("b_box_no")))
    edges = cut_lineage(
        box_pairs(b, b, ["image_id"], cell)
        .where(earlier & over)
        .select("image_id", F.col("a_box_no").alias("src"), F.col("b_box_no").alias("dst"))
    )
    state = cut_lineage(b.select("image_id", "box_no").withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        src = state.select("image_id", F.col("box_no").alias("src"), F.col("kept").alias("_sk"))
        seen = edges.join(src, ["image_id", "src"]).groupBy("image_id", F.col("dst").alias("box_no")).agg(
            F.bool_or(F.coalesce("_sk", F.lit(False))).alias("_hit"), F.bool_or(F.col("_sk").isNull()).alias("_open")
        )
        verdict = F.when(F.coalesce("_hit", F.lit(False)), False).when(~F.coalesce("_open", F.lit(False)), True)
        state = cut_lineage(
            state.join(seen, ["image_id", "box_no"], "left").select("image_id", "box_no", F.coalesce("kept", verdict).alias("kept"))
        )
        if state.where(F.col("kept").isNull()).isEmpty():
            break
    return boxes.join(state.where("kept").select("image_id", "box_no"), ["image_id", "box_no"], "left_semi")
