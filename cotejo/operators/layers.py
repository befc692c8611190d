"""Layer, overlay and transparency signals of PDF files and the risk they add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.numbers import sigmoid
from cotejo.functions.text import extract_all
from cotejo.operators.pdfbytes import as_text

# Patterns of optional content, overlays and graphics operators.
OCG_PATTERNS = [
    "/OCGs", "/OCProperties", r"/OC\s", r"/ON\s+\[", r"/OFF\s+\[", r"/Order\s+\[", "/RBGroups", r"/Locked\s+\[",
    r"/AS\s+<<", r"/Category\s+\[",
]
OVERLAY_PATTERNS = [
    r"/Type\s*/XObject", r"/Subtype\s*/Form", r"/Group\s*<<", r"/S\s*/Transparency", r"/BM\s*/\w+", r"/CA\s+[\d.]+",
    r"/ca\s+[\d.]+",
]
OPERATOR_PATTERNS = [r"q\s+[\d.\-\s]+cm", r"Do\s", r"gs\s", r"/G\d+\s+gs"]


def _count(t: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(p)) for p in patterns]).cast("bigint")


def ocg_signals(raw_docs: DataFrame, streams: DataFrame | None = None, pdf_meta: DataFrame | None = None, window: int | None = None) -> DataFrame:
    """Optional-content hits of the file, pages with hits in their streams, density per MB and coverage."""
    t = as_text(F.col("content"), window)
    size = F.length(F.substring("content", 1, window)) if window else F.length("content")
    docs = raw_docs.select("doc_id", _count(t, OCG_PATTERNS).alias("ocg_count"), size.cast("double").alias("_size"))
    if streams is None or pdf_meta is None:
        docs = docs.withColumn("ocg_pages", F.lit(0)).withColumn("total_pages", F.lit(0))
    else:
        hits = streams.where(as_text(F.col("body")).rlike(r"(?i)/OC(?:MD)?\b")).select("doc_id", "page").distinct()
        pages = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ocg_pages"))
        docs = (
            docs.join(pages, "doc_id", "left")
            .join(pdf_meta.select("doc_id", F.col("pages").alias("total_pages")), "doc_id", "left")
            .fillna(0, ["ocg_pages", "total_pages"])
        )
    density = F.col("ocg_count") / F.greatest(F.lit(1.0), F.col("_size") / 1e6)
    coverage = F.when(F.col("total_pages") > 0, F.col("ocg_pages") / F.col("total_pages")).otherwise(0.0)
    return docs.select(
        "doc_id", "ocg_count", "ocg_pages", density.alias("densidad"), coverage.alias("cobertura"), (F.col("ocg_count") > 0).alias("has_ocg")
    ).withColumn("confianza", ocg_confidence(F.col("ocg_count"), F.col("cobertura"), F.col("densidad")))


def ocg_confidence(count: Column, coverage: Column, density: Column) -> Column:
    """Smooth 0..0.95 confidence from hits, page coverage and density."""
    raw = (
        F.least(count, F.lit(12)) / 12.0 * 0.7
        + F.least(F.lit(1.0), F.greatest(F.lit(0.0), coverage)) * 0.2
        + F.least(F.lit(1.0), F.greatest(F.lit(0.0), density / 20.0)) * 0.1
    )
    base = F.when(count == 0, 0.0).otherwise(0.05)
    return F.least(F.lit(0.95), base + sigmoid((raw - 0.35) * 8.0) * 0.85)


def ocg_confidence_steps(count: Column) -> Column:
    """The older stepwise confidence."""
    return (
        F.when(count >= 5, F.least(F.lit(0.95), F.lit(0.6) + count * 0.05)).when(count >= 2, F.lit(0.4) + count * 0.1).when(count == 1, 0.2).otherwise(0.0)
    )


def overlay_signals(raw_docs: DataFrame, window: int | None = None) -> DataFrame:
    """Overlay, operator and stream counts, alpha values and blend modes of the file."""
    t = as_text(F.col("content"), window)
    alphas = F.filter(
        F.transform(F.concat(extract_all(t, r"/CA\s+([\d.]+)", 1), extract_all(t, r"/ca\s+([\d.]+)", 1)), lambda v: v.try_cast("double")),
        lambda v: v.isNotNull(),
    )
    modes = extract_all(t, r"/BM\s*/(\w+)", 1)
    bodies = F.regexp_count(t, F.lit(r"(?s)stream\s*[\r\n]+(.*?)\s*endstream")).cast("bigint")
    df = raw_docs.select(
        "doc_id",
        _count(t, OVERLAY_PATTERNS).alias("overlay_count"),
        _count(t, OPERATOR_PATTERNS).alias("operadores"),
        F.greatest(bodies, F.lit(1)).alias("streams"),
        alphas.alias("_a"),
        modes.alias("_m"),
        F.regexp_count(t, F.lit(r"stream\s")).cast("bigint").alias("stream_tokens"),
        F.regexp_count(t, F.lit("endstream")).cast("bigint").alias("endstream_tokens"),
    )
    total = F.aggregate("_a", F.lit(0.0), lambda a, v: a + v)
    n, m = F.size("_a"), F.size("_m")
    low = F.size(F.filter("_a", lambda v: v < 1.0))
    odd = F.size(F.filter("_m", lambda x: F.lower(x) != "normal"))
    risk = F.when((F.col("stream_tokens") > 20) | (F.col("operadores") > 50), "high").when(
        (F.col("stream_tokens") > 10) | (F.col("operadores") > 20), "medium"
    )
    return df.select(
        "doc_id",
        "overlay_count",
        "operadores",
        "streams",
        low.cast("bigint").alias("transparencias"),
        F.when(n > 0, low / n).otherwise(0.0).alias("alpha_bajo"),
        F.when(m > 0, odd / m).otherwise(0.0).alias("bm_ratio"),
        F.concat_ws(",", "_m").alias("modos"),
        F.coalesce(F.array_min("_a"), F.lit(0.0)).alias("alpha_min"),
        F.coalesce(F.array_max("_a"), F.lit(0.0)).alias("alpha_max"),
        F.when(n > 0, total / n).otherwise(0.0).alias("alpha_media"),
        (F.col("stream_tokens") == F.col("endstream_tokens")).alias("streams_integros"),
        risk.otherwise("low").alias("nivel_streams"),
    )


def overlay_probability(signals: DataFrame) -> DataFrame:
    """Logistic probability, confidence and level over the overlay signals."""
    over = F.least(F.lit(1.0), F.col("overlay_count") / 20.0)
    any_low = F.when(F.col("transparencias") > 0, 1.0).otherwise(0.0)
    x = (
        F.lit(-2.0)
        + over * 2.0
        + any_low * 1.3
        + F.col("alpha_bajo") * 0.8
        + F.col("bm_ratio") * 0.9
        + F.least(F.lit(1.0), F.col("operadores") / 50.0) * 0.7
        + F.least(F.lit(1.0), F.col("streams") / 12.0) * 0.3
    )
    p = sigmoid(x)
    strong = any_low + F.when(F.col("bm_ratio") > 0, 1).otherwise(0) + F.when(over > 0.4, 1).otherwise(0)
    steady = F.col("alpha_bajo") * 0.5 + F.least(F.lit(1.0), over * 1.5) * 0.5
    confidence = F.greatest(F.lit(0.35), F.least(F.lit(0.95), F.lit(0.40) + strong * 0.18 + steady * 0.25))
    return signals.select(
        "doc_id",
        ((F.col("overlay_count") > 3) | (F.col("transparencias") > 0) | (F.col("bm_ratio") >= 0.2)).alias("has_overlays"),
        F.when(F.col("overlay_count") > 3, over).otherwise(0.0).alias("overlay_score"),
        F.round(p, 4).alias("probabilidad"),
        F.when(p >= 0.75, "HIGH").when(p >= 0.5, "MEDIUM").otherwise("LOW").alias("nivel"),
        F.round(confidence, 3).alias("confianza"),
    )


# Component weights, level thresholds and share of the base weight per level.
COMPONENT_WEIGHTS = {"ocg": 0.35, "overlay": 0.25, "texto": 0.25, "estructura": 0.15}
LAYER_LEVELS = [("VERY_HIGH", 0.8, 1.0), ("HIGH", 0.6, 0.8), ("MEDIUM", 0.4, 0.6), ("LOW", 0.2, 0.4), ("VERY_LOW", None, 0.2)]


def _by_level(score: Column, pick) -> Column:
    out = None
    for row in LAYER_LEVELS:
        if row[1] is None:
            return out.otherwise(pick(row))
        test = score >= row[1]
        out = F.when(test, pick(row)) if out is None else out.when(test, pick(row))


def layer_risk(ocg: DataFrame, overlays: DataFrame, text: DataFrame, structure: DataFrame, base_weight: int = 15) -> DataFrame:
    """Weighted layer score with level, penalty and estimated number of layers.

    ocg: ocg_signals; overlays: overlay_probability with overlay_count; text: text_overlap;
    structure: (doc_id, sospechosa, puntaje).
    """
    df = (
        ocg.select("doc_id", "has_ocg", "ocg_count", F.col("confianza").alias("_oc"))
        .join(overlays.select("doc_id", "has_overlays", "overlay_score", "overlay_count"), "doc_id", "left")
        .join(text.select("doc_id", F.col("probabilidad").alias("_tp")), "doc_id", "left")
        .join(structure.select("doc_id", "sospechosa", F.col("puntaje").alias("_sp")), "doc_id", "left")
        .fillna(0.0, ["overlay_score", "_tp", "_sp"])
        .fillna(0, ["overlay_count"])
        .fillna(False, ["has_overlays", "sospechosa"])
    )
    w = COMPONENT_WEIGHTS
    score = (
        F.when(F.col("has_ocg"), F.col("_oc") * w["ocg"]).otherwise(0.0)
        + F.when(F.col("has_overlays"), F.col("overlay_score") * w["overlay"]).otherwise(0.0)
        + F.col("_tp") * w["texto"]
        + F.when(F.col("sospechosa"), F.col("_sp") * w["estructura"]).otherwise(0.0)
    )
    estimate = (
        F.when(F.col("ocg_count") > 0, F.least(F.floor(F.col("ocg_count") / 2), F.lit(10)))
        .when(F.col("overlay_count") > 10, F.least(F.floor(F.col("overlay_count") / 5), F.lit(8)))
        .otherwise(0)
    )
    return df.withColumn("_s", score).select(
        "doc_id",
        F.bround("_s", 3).alias("puntaje"),
        F.bround(F.col("_s") * 100, 1).alias("porcentaje"),
        _by_level(F.col("_s"), lambda r: F.lit(r[0])).alias("nivel"),
        layer_penalty(F.col("_s"), base_weight).alias("penalizacion"),
        F.bround(F.least(F.lit(1.0), F.col("_s") + 0.1), 3).alias("confianza"),
        estimate.cast("bigint").alias("capas_estimadas"),
    ).withColumn("has_layers", F.col("nivel") != "VERY_LOW")


def layer_penalty(score: Column, base_weight: int = 15, level: Column | None = None) -> Column:
    """Larger of the proportional and the stepped penalty; halves round to even."""
    share = _by_level(score, lambda r: F.lit(r[2]))
    if level is not None:
        stated = F.lit(0.2)
        for name, _, s in LAYER_LEVELS:
            stated = F.when(level == name, s).otherwise(stated)
        share = F.when(level.isNotNull(), stated).otherwise(share)
    return F.greatest(F.bround(score * base_weight), F.bround(share * base_weight)).cast("int")


def structure_stats(blocks: DataFrame, overlaps: DataFrame, images: DataFrame, drawings: DataFrame, pages: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Objects per page and overlapping text blocks; suspicious above 50 objects or 5 overlaps.

    overlaps: (doc_id, page, solapes) of block_overlaps; pages: (doc_id, pages). The older rules
    (any page above 2 overlaps; above 3 in all, 100 objects or 2 startxref) come as extra flags.
    """
    one = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    objects = one(blocks).unionByName(one(images)).unionByName(one(drawings)).groupBy("doc_id").agg(F.sum("n").alias("_obj"))
    over = overlaps.groupBy("doc_id").agg(F.sum("solapes").alias("_ov"), F.max("solapes").alias("_page_max"))
    df = pages.select("doc_id", "pages").join(objects, "doc_id", "left").join(over, "doc_id", "left")
    if starts is not None:
        df = df.join(starts.select("doc_id", "startxref"), "doc_id", "left")
    else:
        df = df.withColumn("startxref", F.lit(0))
    df = df.fillna(0, ["_obj", "_ov", "_page_max", "startxref"])
    per_page = F.col("_obj") / F.greatest(F.lit(1), F.col("pages"))
    return df.select(
        "doc_id",
        F.col("_obj").alias("objetos"),
        per_page.alias("objetos_por_pagina"),
        F.col("_ov").alias("solapes"),
        F.least(F.lit(1.0), per_page / 100 + F.col("_ov") / 10).alias("puntaje"),
        ((per_page > 50) | (F.col("_ov") > 5)).alias("sospechosa"),
        ((F.col("_page_max") > 2) | (per_page > 50)).alias("sospechosa_por_pagina"),
        ((F.col("_ov") > 3) | (per_page > 100) | (F.col("startxref") > 2)).alias("sospechosa_previa"),
    )


# ---------------------------------------------------------------- rendered layers

CHANGED = 0.05


def layer_changes(layer_diffs: DataFrame) -> DataFrame:
    """Per document: rendered elements, changing ones and their share, by kind."""
    changed = F.col("diff_ratio") > CHANGED
    kind = lambda k: F.col("kind") == k
    return layer_diffs.groupBy("doc_id").agg(
        *[F.count_if(kind(k)).alias(f"total_{k}") for k in ("stream", "annot", "ocg")],
        *[F.count_if(kind(k) & changed).alias(f"cambios_{k}") for k in ("stream", "annot", "ocg")],
        F.avg(changed.cast("double")).alias("proporcion"),
    )


def first_changing_stream(layer_diffs: DataFrame) -> DataFrame:
    """Per page the first stream whose rendering changes, zero-based like the stream list."""
    s = layer_diffs.where(F.col("kind") == "stream")
    return s.groupBy("doc_id", "page").agg(
        F.min(F.when(F.col("diff_ratio") > CHANGED, F.col("k"))).alias("primer_stream"), F.count(F.lit(1)).alias("streams")
    )


def context_factor(pdf_meta: DataFrame, stream_counts: DataFrame) -> DataFrame:
    """Damping for originals: equal dates, known generators, very few streams; never under 0.1."""
    df = pdf_meta.join(stream_counts.select("doc_id", "n_streams"), "doc_id", "left")
    same = (F.col("creation_date") != "") & (F.col("creation_date") == F.col("mod_date"))
    maker = F.lower(F.coalesce("producer", F.lit(""))).rlike("itext|adobe")
    f = (
        F.when(F.coalesce(same, F.lit(False)), 0.3).otherwise(1.0)
        * F.when(maker, 0.7).otherwise(1.0)
        * F.when(F.coalesce("n_streams", F.lit(0)) <= 2, 0.5).otherwise(1.0)
    )
    return df.select("doc_id", F.greatest(f, F.lit(0.1)).alias("factor"))


def _level(p: Column, high: float, medium: float) -> Column:
    return F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def layer_probability(changes: DataFrame, factor: DataFrame) -> DataFrame:
    """Share of changing elements damped by the context, with its level."""
    p = F.coalesce("proporcion", F.lit(0.0)) * F.col("factor")
    return changes.join(factor, "doc_id").select("doc_id", F.bround(p, 3).alias("probabilidad"), _level(p, 0.6, 0.3).alias("nivel"))


def stream_probability(first_streams: DataFrame, factor: DataFrame) -> DataFrame:
    """Share of pages with a changing stream damped by the context, with its level."""
    share = first_streams.groupBy("doc_id").agg((F.count("primer_stream") / F.count(F.lit(1))).alias("_p"))
    p = F.col("_p") * F.col("factor")
    return share.join(factor, "doc_id").select("doc_id", F.bround(p, 3).alias("probabilidad"), _level(p, 0.6, 0.3).alias("nivel"))


def visual_probability(counts: DataFrame) -> DataFrame:
    """Annotations 0.4, covering elements 0.3, visible difference 0.3, from (doc_id, anotaciones, sospechosos, paginas_diff)."""
    p = (
        F.when(F.col("anotaciones") > 0, 0.4).otherwise(0.0)
        + F.when(F.col("sospechosos") > 0, 0.3).otherwise(0.0)
        + F.when(F.col("paginas_diff") > 0, 0.3).otherwise(0.0)
    )
    p = F.bround(p, 3)
    return counts.select("doc_id", p.alias("probabilidad"), _level(p, 0.7, 0.4).alias("nivel"))


def patch_images(pdf_images: DataFrame) -> DataFrame:
    """Images that may hide text: tiny, uniform, or with straight borders (share given)."""
    small = (F.col("w_px") < 50) | (F.col("h_px") < 50)
    edged = F.coalesce(F.col("border_share") > 0.1, F.lit(False))
    return pdf_images.where(small | (F.col("variance") < 10) | edged)


def patch_stats(pdf_images: DataFrame) -> DataFrame:
    small = (F.col("w_px") < 50) | (F.col("h_px") < 50)
    flat = F.col("variance") < 10
    patch = F.coalesce(small | flat | F.coalesce(F.col("border_share") > 0.1, F.lit(False)), F.lit(False))
    df = pdf_images.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("imagenes"),
        F.count_if(patch).alias("parches"),
        F.sum("n_bytes").alias("bytes"),
        F.count_if(small).alias("pequenas"),
        F.count_if(flat).alias("uniformes"),
    )
    p = F.col("parches") / F.col("imagenes")
    return df.withColumn("probabilidad", F.bround(p, 3)).withColumn("nivel", _level(p, 0.5, 0.2))


def overlay_summary(visual: DataFrame, stream: DataFrame, layer: DataFrame, patches: DataFrame) -> DataFrame:
    """Highest probability of the four analyses; HIGH if any is HIGH or from 0.6, MEDIUM from 0.3.

    The check level that is charged looks only at layers, the visual analysis and the images.
    """
    part = lambda df, n: df.select("doc_id", F.lit(n).alias("analisis"), "probabilidad", "nivel")
    rows = part(visual, "visual").unionByName(part(stream, "stream")).unionByName(part(layer, "capas")).unionByName(part(patches, "imagenes"))
    found = F.when(F.col("analisis") == "visual", F.col("probabilidad") > 0.5).otherwise(F.col("probabilidad") > 0)
    rank = F.when(F.col("nivel") == "HIGH", 2).when(F.col("nivel") == "MEDIUM", 1).otherwise(0)
    charged = F.max(F.when(F.col("analisis") != "stream", rank))
    p, high = F.max("probabilidad"), F.count_if(F.col("nivel") == "HIGH")
    return rows.groupBy("doc_id").agg(
        p.alias("probabilidad"),
        F.when((high > 0) | (p >= 0.6), "HIGH").when(p >= 0.3, "MEDIUM").otherwise("LOW").alias("nivel_riesgo"),
        F.count_if(found).alias("zonas"),
        F.when(charged == 2, "HIGH").when(charged == 1, "MEDIUM").otherwise("LOW").alias("nivel_capas"),
    )


def annot_census(annots: DataFrame) -> DataFrame:
    """Annotations per document and subtype."""
    return annots.groupBy("doc_id", "subtype").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("subtype").isin("FreeText", "Text", "Note")).alias("de_texto"),
        F.count_if(F.col("x0").isNotNull()).alias("con_rectangulo"),
    )


def suspicious_annots(annots: DataFrame) -> DataFrame:
    """Oversized annotations, and empty shapes that still draw something."""
    big = (F.col("x1") - F.col("x0") > 200) | (F.col("y1") - F.col("y0") > 50)
    hollow = (F.coalesce("content", F.lit("")) == "") & F.col("has_appearance") & F.col("subtype").isin("Square", "Rectangle", "Stamp")
    return annots.where(F.coalesce(big, F.lit(False)) | F.coalesce(hollow, F.lit(False)))
