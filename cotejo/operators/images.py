"""Image metadata, recognised tokens, hashes and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.functions.dates import meta_date, whole_days
from cotejo.functions.hashes import hamming64
from cotejo.functions.numbers import ramp
from cotejo.functions.text import contains_any, strip
from cotejo.operators.boxes import box_pairs
from cotejo.operators.pdfbytes import suspicion_label
from cotejo.skew import chunked_lag

# Names of editing programs and messaging apps.
EDITORS = ["photoshop", "gimp", "affinity", "pixelmator", "lightroom", "illustrator", "acrobat"]
EDITOR_GROUPS = [
    ("photoshop", ["photoshop", "adobe"]), ("gimp", ["gimp"]), ("paint", ["paint", "mspaint"]), ("canva", ["canva"]),
    ("mensajeria", ["whatsapp", "telegram"]),
]
MESSAGING = ["whatsapp", "telegram", "instagram"]
EXIF_DATES = ["DateTimeOriginal", "DateTimeDigitized", "DateTime", "ModifyDate", "CreateDate"]


def _get(m: str, key: str) -> Column:
    """Trimmed map value, empty when absent."""
    return F.coalesce(strip(F.try_element_at(F.col(m), F.lit(key))), F.lit(""))


def editor_hits(image_meta: DataFrame) -> DataFrame:
    """Editing software named in the metadata, by rule set."""
    soft, tool = F.lower(_get("exif", "Software")), F.lower(_get("xmp", "CreatorTool"))
    group = None
    for name, words in EDITOR_GROUPS:
        test = contains_any(soft, words)
        group = F.when(test, name) if group is None else group.when(test, name)
    maker = F.lower(F.concat_ws(" ", _get("exif", "Make"), _get("exif", "Model")))
    no_device = (_get("exif", "Make") == "") & (_get("exif", "Model") == "")
    described = contains_any(F.lower(_get("exif", "ImageDescription")), ["edit", "modify", "fake", "test"])
    dates = F.array_distinct(F.filter(F.array(*[_get("exif", k) for k in EXIF_DATES[:3]]), lambda d: d != ""))
    return image_meta.select(
        "image_id",
        (contains_any(soft, EDITORS) | contains_any(tool, EDITORS)).alias("editor"),
        group.alias("grupo"),
        contains_any(maker, MESSAGING).alias("camara_es_app"),
        (no_device & (_get("exif", "MakerNote") == "")).alias("posible_app"),
        (contains_any(soft, ["photoshop", "gimp", "paint", "editor"]) | described | (F.size(dates) > 1)).alias("metadatos_sospechosos"),
    )


def pick_dates(image_meta: DataFrame) -> DataFrame:
    """Creation and modification time by precedence, with the source of the dates."""
    first = lambda m, *keys: meta_date(F.substring(F.coalesce(*[F.nullif(_get(m, k), F.lit("")) for k in keys]), 1, 19))
    original, digitized, modified = first("exif", "DateTimeOriginal", "DateTime"), first("exif", "DateTimeDigitized"), first("exif", "DateTime")
    x_create, x_modify = first("xmp", "CreateDate", "DateCreated"), first("xmp", "ModifyDate", "MetadataDate")
    d = image_meta.select("image_id", original.alias("_o"), digitized.alias("_d"), modified.alias("_m"), x_create.alias("_xc"), x_modify.alias("_xm"))
    source = (
        F.when(F.col("_o").isNotNull(), "EXIF").when(F.col("_xc").isNotNull(), "XMP").when(F.col("_d").isNotNull() | F.col("_m").isNotNull(), "EXIF")
    )
    return d.select("image_id", F.coalesce("_o", "_xc", "_d").alias("creacion"), F.coalesce("_m", "_xm").alias("modificacion"), source.otherwise("No disponible").alias("fuente"))


def image_dates(image_meta: DataFrame) -> DataFrame:
    """(image_id, campo, ts): every readable date of both maps."""
    named = F.transform(F.array(*[F.lit(k) for k in EXIF_DATES]), lambda k: F.struct(F.concat(F.lit("exif_"), k).alias("campo"), meta_date(F.try_element_at("exif", k)).alias("ts")))
    xmp = F.transform(F.map_entries("xmp"), lambda e: F.struct(e["key"].alias("campo"), meta_date(e["value"]).alias("ts")))
    every = F.filter(F.concat(named, F.coalesce(xmp, F.array().cast("array<struct<campo: string, ts: timestamp_ntz>>"))), lambda e: e["ts"].isNotNull())
    return image_meta.select("image_id", F.inline(every))


def date_gaps(dates: DataFrame, max_days: int = 365) -> DataFrame:
    """Gaps over a year between consecutive dates of an image, eight points each.

    Dates are cut by year before the window, so an image with very many of them is not one group;
    equal dates add nothing and collapse first.
    """
    unique = dates.select("image_id", "ts").distinct()
    lagged = chunked_lag(unique, ["image_id"], "ts", F.year("ts"), ["ts"])
    gap = whole_days(F.col("ts"), F.col("prev_ts"))
    return lagged.groupBy("image_id").agg(
        F.coalesce(F.max(gap), F.lit(0)).alias("mayor_brecha"), F.count_if(gap > max_days).alias("brechas"), (F.count_if(gap > max_days) * 8).alias("puntos")
    )


# EXIF fields that count towards a filled record.
EXIF_FIELDS = [
    "Make", "Model", "Software", "Artist", "Copyright", "ImageDescription", "Orientation", "XResolution", "YResolution",
    "ResolutionUnit", "ColorSpace", "ExifVersion", "Flash", "FocalLength", "FNumber", "ExposureTime", "ISOSpeedRatings", "WhiteBalance",
]


def date_consistency(image_meta: DataFrame, now: str, advanced: bool = False) -> DataFrame:
    """Points for implausible metadata dates, capped at 50; `advanced` is the variant with the editor rule.

    An image has a dozen dates at most, so the rules run on arrays inside the row.
    """
    at = F.lit(now).cast("timestamp_ntz")
    e = lambda k: meta_date(F.try_element_at("exif", F.lit(k)))
    xmp = F.transform(F.map_entries("xmp"), lambda x: F.struct(x["key"].alias("campo"), meta_date(x["value"]).alias("ts")))
    own = F.array(*[F.struct(F.lit(f"exif_{k}").alias("campo"), e(k).alias("ts")) for k in EXIF_DATES])
    keep = lambda a: F.filter(a, lambda x: x["ts"].isNotNull())
    # a packet entry replaces a record entry of the same name
    renamed = F.filter(own, lambda o: ~F.exists(keep(xmp), lambda x: x["campo"] == o["campo"]))
    df = image_meta.select(
        "image_id", "exif", "xmp", keep(F.concat(renamed, F.coalesce(xmp, F.array().cast("array<struct<campo: string, ts: timestamp_ntz>>")))).alias("_d")
    )
    named = lambda k: F.get(F.filter("_d", lambda x: x["campo"] == k), F.lit(0))["ts"]
    times = F.array_sort(F.transform("_d", lambda x: x["ts"]))
    df = df.withColumns({"_t": times, "_o": named("exif_DateTimeOriginal"), "_g": named("exif_DateTimeDigitized"), "_m": F.coalesce(named("exif_ModifyDate"), named("exif_DateTime"))})
    n_exif = F.size(F.filter(F.array(*[_get("exif", k) for k in EXIF_DATES]), lambda v: v != ""))
    filled = F.size(F.filter(F.array(*[_get("exif", k) for k in EXIF_FIELDS]), lambda v: (v != "") & (v != "0")))
    has_exif = F.size(F.map_keys("exif")) > 0
    camera = F.size(F.filter(F.array(*[_get("exif", k) for k in ("Make", "Model", "Software", "Artist")]), lambda v: v != ""))
    gaps = F.zip_with(F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1))), F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), whole_days)
    latest = lambda word: F.array_max(F.transform(F.filter("_d", lambda x: F.lower(x["campo"]).contains(word)), lambda x: x["ts"]))
    hours = F.timestamp_diff("SECOND", latest("exif"), latest("xmp")) / 3600
    res = lambda k: F.coalesce(_get("exif", k).try_cast("double"), F.lit(0.0))
    other = F.exists(F.array(*[_get("exif", k) for k in ("Software", "Artist", "Copyright")]), lambda v: v != "")
    no_device = (_get("exif", "Make") == "") & (_get("exif", "Model") == "")
    future = F.size(F.filter("_t", lambda t: t > at))
    points = lambda test, k: F.when(F.coalesce(test, F.lit(False)), k).otherwise(0)
    rules = {
        "sin_fechas": points(n_exif == 0, 15),
        "exif_minimo": points(has_exif & (filled <= 2), 10),
        "sin_camara": points(has_exif & (camera == 0), 5),
        "original_tras_digital": points(F.col("_o") > F.col("_g"), 15),
        "digital_tras_cambio": points(F.col("_g") > F.col("_m"), 10),
        "futuras": future * 20,
        "identicas": points(F.size(F.array_distinct("_t")) == 1, 12),
    }
    if advanced:
        rules["editor"] = points(contains_any(F.lower(_get("exif", "Software")), EDITORS), 8)
    else:
        rules |= {
            "brechas": F.size(F.filter(gaps, lambda d: d > 365)) * 8,
            "antiguas": F.size(F.filter("_t", lambda t: t < F.lit("1990-01-01").cast("timestamp_ntz"))) * 5,
            "de_software": points(F.exists("_d", lambda x: F.lower(x["campo"]).rlike("software|creator")), 3),
            "xmp_posterior": points(hours > 1, 8),
            "mensajeria": points(has_exif & contains_any(F.lower(_get("exif", "Software")), MESSAGING), 3),
            "resolucion": points(has_exif & (res("XResolution") > 0) & (res("YResolution") > 0) & (res("XResolution") != res("YResolution")), 2),
            "camara_ausente": points(has_exif & no_device & other, 8),
        }
    total = sum(rules.values(), F.lit(0))
    fired = F.array_compact(F.array(*[F.when(v > 0, n) for n, v in rules.items()]))
    return df.select("image_id", F.size("_d").alias("fechas"), F.least(F.lit(50), total).cast("int").alias("puntos"), F.concat_ws(",", fired).alias("reglas"))


# ---------------------------------------------------------------- hashes


def adjacent_hash(block_hashes: DataFrame) -> DataFrame:
    """Distances between consecutive block hashes of an image and the share of outliers."""
    lagged = chunked_lag(block_hashes, ["image_id"], "block_no", F.floor(F.col("block_no") / 4096), ["phash"])
    d = lagged.where(F.col("prev_phash").isNotNull()).select("image_id", hamming64(F.col("phash"), F.col("prev_phash")).alias("d"))
    g = d.groupBy("image_id").agg(F.count(F.lit(1)).alias("comparaciones"), F.avg("d").alias("media"), F.stddev_pop("d").alias("desviacion"), F.max("d").alias("maximo"))
    far = F.avg((F.col("d") > F.col("media") + F.col("desviacion") * 2).cast("double"))
    share = d.join(g, "image_id").groupBy("image_id").agg(far.alias("proporcion"))
    p = F.col("proporcion")
    return g.join(share, "image_id").withColumn("nivel", F.when(p > 0.3, "ALTO").when(p > 0.2, "MEDIO").otherwise("BAJO"))


def hash_variants(variants: DataFrame, limit: int = 15) -> DataFrame:
    """(image_id, phash, phash_rotado, phash_escalado): sensitive when a variant moves over 15 bits."""
    rot, scale = hamming64(F.col("phash"), F.col("phash_rotado")), hamming64(F.col("phash"), F.col("phash_escalado"))
    return variants.select("image_id", rot.alias("rotacion"), scale.alias("escala"), (rot > limit).alias("sensible_rotacion"), (scale > limit).alias("sensible_escala"))


# ---------------------------------------------------------------- tokens


def filter_tokens(tokens: DataFrame, profile: str = "overlay") -> DataFrame:
    """Usable recognised tokens: `overlay`, `numeric` or `confident` (needs page_width and page_height)."""
    text = strip(F.col("text"))
    if profile == "numeric":
        digits = F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.length(text)
        return tokens.where((F.col("conf") >= 40) & (F.col("width") >= 20) & (F.col("height") >= 10) & (text != "") & (digits >= 0.6))
    if profile == "confident":
        sized = (F.col("height") >= 20) & (F.col("width") >= 20) & (F.col("width") <= F.col("page_width") * 0.6) & (F.col("height") <= F.col("page_height") * 0.1)
        return tokens.where((text != "") & (F.col("conf") >= 80) & sized)
    return tokens.where((F.length(text) >= 3) & (F.col("conf") >= 30))


def token_overlay(token_stats: DataFrame) -> DataFrame:
    """Points per token for flat, hard-edged text; suspicious from 3."""
    contrast = F.col("max") - F.col("min")
    rules = [
        ("baja_varianza", F.col("var") < 50, 3), ("bordes_duros", (contrast > 200) & (F.col("std") < 30), 2), ("no_alineado_bordes", F.col("edge_share") < 0.1, 2),
        ("muy_uniforme", F.col("std") < 20, 1), ("alto_contraste", contrast > 250, 1),
    ]
    score = sum((F.when(test, p).otherwise(0) for _, test, p in rules), F.lit(0))
    why = F.array_compact(F.array(*[F.when(test, n) for n, test, _ in rules]))
    return token_stats.select("image_id", "token_no", score.alias("puntos"), F.concat_ws(",", why).alias("razones"), (score >= 3).alias("sospechoso"))


def font_size_groups(tokens: DataFrame) -> DataFrame:
    """Spread of token sizes: three size groups, uneven heights or proportions are suspicious."""
    aspect = F.col("width") / F.greatest("height", F.lit(1))
    g = tokens.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("textos"), F.avg("height").alias("alto_medio"), F.avg("width").alias("ancho_medio"),
        F.stddev_pop("height").alias("alto_sd"), F.stddev_pop("width").alias("ancho_sd"), F.stddev_pop(aspect).alias("aspecto_sd"),
    )
    size = F.when(F.col("height") < F.col("alto_medio") * 0.8, 0).when(F.col("height") > F.col("alto_medio") * 1.2, 2).otherwise(1)
    groups = tokens.join(g, "image_id").groupBy("image_id").agg(F.count_distinct(size).alias("grupos"))
    enough = F.col("textos") >= 2
    odd = (F.col("grupos") > 2) | (F.col("alto_sd") > F.col("alto_medio") * 0.5) | (F.col("aspecto_sd") > 0.5)
    return g.join(groups, "image_id").withColumn("sospechoso", enough & odd)


def top_words(tokens: DataFrame, k: int = 3, threshold: float = 0.8) -> DataFrame:
    """The k most confident usable words per image with their overlay score."""
    order = W.partitionBy("image_id").orderBy(F.desc("conf"), "token_no")
    best = filter_tokens(tokens, "confident").withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= k)
    size = F.least(F.lit(1.0), F.col("width") * F.col("height") / (F.col("page_width") * F.col("page_height") * 0.01))
    score = F.col("conf") / 100.0 * 0.7 + size * 0.3
    return best.select("image_id", "token_no", "puesto", F.round(score, 3).alias("puntaje"), (score >= threshold).alias("overlay"))


def top_suspects(boxes: DataFrame, k: int = 10, score: str = "puntaje", tie: str = "box_no") -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.desc(score), tie)
    return boxes.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= k)


def synthetic_text(token_stats: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """Flattened synthetic text from box measurements: stroke, colour and halo over at least 30 boxes.

    token_stats: image_id, sw_mean, sw_std, n_pts, puro boolean, halo. text: (image_id, text) to see
    whether amounts or dates are present.
    """
    enough = F.col("n_pts") >= 10
    g = token_stats.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("cajas"),
        F.coalesce(F.avg(F.when(enough, F.col("sw_mean"))), F.lit(0.0)).alias("trazo"),
        F.coalesce(F.avg(F.when(enough, F.col("sw_std"))), F.lit(0.0)).alias("trazo_sd"),
        F.avg(F.col("puro").cast("double")).alias("puros"),
        F.avg("halo").alias("halo"),
    )
    cv = F.when(F.col("trazo") > 0, F.col("trazo_sd") / (F.col("trazo") + 1e-6)).otherwise(1.0)
    stroke = (cv < 0.45) & (F.col("trazo") >= 1.2)
    pure, halo = F.col("puros") >= 0.6, F.col("halo") >= 0.45
    met = stroke.cast("int") + pure.cast("int") + halo.cast("int")
    found = (F.col("cajas") >= 30) & (met >= 2)
    if text is not None:
        money = F.lower("text").rlike(r"(?:\$?\s*)\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})")
        day = F.col("text").rlike(r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})")
        g = g.join(text.select("image_id", (money | day).alias("_hit")), "image_id", "left")
    else:
        g = g.withColumn("_hit", F.lit(False))
    level = F.when(found & F.coalesce("_hit", F.lit(False)), "ALTO").when(found, "MEDIO").otherwise("BAJO")
    return g.select("image_id", "cajas", "trazo", cv.alias("trazo_cv"), "puros", "halo", found.alias("tiene_texto_sintetico"), level.alias("nivel"))


def overlay_boxes(token_stats: DataFrame) -> DataFrame:
    """Overlaid text or scribbles per box: seven flags, two rules and a weighted score.

    Needs y0 and height of the image for the logo strip: boxes in the top 15% are skipped when given.
    """
    boost = F.col("ela_in") / F.greatest(F.lit(1e-6), F.col("ela_ring"))
    flags = {
        "trazo": F.col("sw_cv") <= 0.55,
        "halo_ok": F.col("halo") >= 0.45,
        "ela_ok": boost >= 1.8,
        "ruido_ok": F.col("z_hf") <= -1.5,
        "coherente": F.col("coherence") >= 0.22,
        "pocos_tonos": (F.col("entropy") <= 4.0) & (F.col("dom_bins") <= 25),
        "color": F.col("colorish"),
    }
    weights = {"trazo": 3, "halo_ok": 2, "ela_ok": 2, "ruido_ok": 2, "coherente": 1, "pocos_tonos": 1, "color": 2}
    df = token_stats
    if {"y0", "image_height"} <= set(df.columns):
        df = df.where(F.col("y0") > F.floor(F.col("image_height") * 0.15))
    numeric = F.col("es_numerico") if "es_numerico" in df.columns else F.lit(False)
    df = df.withColumns(flags)
    neutral = F.col("trazo") & (F.col("halo_ok") | F.col("ela_ok")) & F.col("ruido_ok") & F.col("coherente")
    colour = F.col("color") & F.col("trazo") & F.col("coherente")
    score = sum((F.col(n).cast("int") * w for n, w in weights.items()), F.coalesce(numeric, F.lit(False)).cast("int"))
    kind = F.when(neutral & ~colour, "texto_neutro").when(colour & ~neutral, "overlay_color").otherwise("mixto")
    return df.where(neutral | colour).select("image_id", "token_no", score.alias("puntaje"), kind.alias("tipo"))


def injected_numbers(token_stats: DataFrame) -> DataFrame:
    """Numbers typed onto an image: tokens firing at 14 points, and the level of their sum per image.

    token_stats: image_id, token_no, sw_mean, sw_cv, ela_in, ela_ring, entropy (nats), edge_share.
    """
    ratio = (F.col("ela_in") + 1e-6) / (F.col("ela_ring") + 1e-6)
    points = (
        F.when((F.col("sw_cv") <= 0.55) & (F.col("sw_mean") >= 1.0), 10).otherwise(0)
        + F.when((ratio >= 1.5) & (F.col("ela_in") >= 0.02), 8).otherwise(0)
        + F.when(F.col("entropy") <= 3.0, 6).otherwise(0)
        + F.when(F.col("edge_share") >= 0.18, 6).otherwise(0)
    )
    fired = F.when(points >= 14, points)
    total = F.coalesce(F.sum(fired), F.lit(0))
    return token_stats.groupBy("image_id").agg(
        F.count(fired).alias("sospechosos"),
        F.least(F.lit(100), total).alias("puntaje"),
        F.when(total >= 25, "PRIORITARIO").when(total >= 14, "MEDIO").otherwise("BAJO").alias("nivel"),
    )


def coloured_overlays(components: DataFrame) -> DataFrame:
    """Coloured strokes over text: components that look like strokes, scored by their number."""
    ok = (
        (F.col("area") >= 40) & (F.col("area_share") <= 0.015) & F.col("aspect").between(2, 20) & (F.col("edge_ratio") >= 0.6) & (F.col("w_cv") < 0.5)
        & (F.col("roi_inter") >= 0.10) & (F.col("solidity") >= 0.6) & (F.coalesce("hue_var", F.lit(0.0)) <= 8)
    )
    n = F.count_if(ok)
    base = F.when(n >= 3, 50).when(n >= 2, 40).when(n >= 1, 25).otherwise(0)
    g = components.groupBy("image_id").agg(n.alias("trazos"), F.max("colour_share").alias("_c"), base.alias("_b"))
    score = F.when(F.col("_c") > 0.05, F.greatest(F.lit(0), F.col("_b") - 20)).otherwise(F.col("_b"))
    return g.select("image_id", "trazos", score.alias("puntaje"), ((score >= 25) & (F.col("trazos") >= 1)).alias("coincide"))


def _near_pairs(angles: DataFrame, apart: float) -> DataFrame:
    """(image_id, pares_paralelos): pairs of lines less than `apart` degrees apart, of counted angles (image_id, a, c)."""
    adds = angles.select("image_id", F.col("a").alias("x"), F.lit(1).alias("kind"), "c", F.col("c").alias("w"))
    asks = angles.select("image_id", (F.col("a") + apart).alias("x"), F.lit(0).alias("kind"), "c", F.lit(0).cast("bigint").alias("w"))
    events = adds.unionByName(asks).withColumn("b", F.floor(F.col("x") / apart))
    before = F.sum("t").over(W.partitionBy("image_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    offsets = events.groupBy("image_id", "b").agg(F.sum("w").alias("t")).select("image_id", "b", F.coalesce(before, F.lit(0)).alias("o"))
    inside = F.sum("w").over(W.partitionBy("image_id", "b").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0))
    upto = events.withColumn("_i", inside).join(offsets, ["image_id", "b"]).withColumn("_s", F.col("_i") + F.col("o"))
    # lines short of a + apart, less those up to a, and the pairs of equal angles
    signed = F.when(F.col("kind") == 0, F.col("c") * F.col("_s")).otherwise(F.floor(F.col("c") * (F.col("c") - 1) / 2) - F.col("c") * F.col("_s"))
    return upto.groupBy("image_id").agg(F.sum(signed).cast("bigint").alias("pares_paralelos"))


def line_angles(segments: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Direction groups of straight lines, near-parallel pairs and lines that end inside a cluster.

    Pairs within five degrees are counted by running sums: equal angles collapse to one counted row, and the lines up to an angle and
    those short of five degrees more are read from sums over five-degree buckets, so angles are never joined with angles.
    """
    rad = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    s = segments.withColumn("a", F.degrees(rad))
    folded = F.pmod(F.abs(F.col("a")), F.lit(180.0))
    per_bucket = s.groupBy("image_id", (F.rint(folded / 5.0) * 5).cast("int").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    n = per_bucket.groupBy("image_id").agg(F.sum("_n").alias("lineas"))
    groups = per_bucket.join(n, "image_id").groupBy("image_id").agg(
        F.count_if(F.col("_n") >= F.greatest(F.lit(3), F.floor(F.col("lineas") / 10))).alias("grupos"), F.first("lineas").alias("lineas")
    )
    hist = s.groupBy("image_id", F.floor((F.col("a") + 180) / 10).alias("_h")).agg(F.count(F.lit(1)).alias("_c")).groupBy("image_id").agg(F.count_if(F.col("_c") > 1).alias("direcciones"))
    pairs = _near_pairs(s.groupBy("image_id", "a").agg(F.count(F.lit(1)).alias("c")), 5.0)
    out = groups.join(hist, "image_id").join(pairs, "image_id")
    if clusters is None:
        return out.withColumn("en_clusters", F.lit(0.0))
    numbered = s.withColumn("_id", F.xxhash64("x1", "y1", "x2", "y2"))
    tips = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    ends = numbered.select("image_id", "_id", F.explode(tips).alias("e"))
    points = ends.select("image_id", "_id", *[F.col(f"e.{c[0]}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    areas = clusters.where("localizado").select("image_id", "x0", "y0", "x1", "y1")
    inside = box_pairs(points, areas, ["image_id"]).select("image_id", F.col("a__id").alias("_id"))
    touched = inside.distinct()
    hits = numbered.join(touched, ["image_id", "_id"], "left_semi").groupBy("image_id").agg(F.count(F.lit(1)).alias("_t"))
    return out.join(hits, "image_id", "left").withColumn("en_clusters", F.coalesce("_t", F.lit(0)) / F.col("lineas")).drop("_t")


# ---------------------------------------------------------------- decisions


def noise_decision(signals: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """Local editing from outlier share, compact clusters, halo and lines in clusters."""
    base = (F.col("outliers") > min_ratio) & (F.col("clusters") > 0)
    score = (
        F.when(F.col("halo") >= 0.45, 2).otherwise(0)
        + F.when((F.col("en_clusters") >= 0.35) & (F.col("grupos") >= 1), 1).otherwise(0)
        + F.when(F.col("outliers") > 0.12, 1).otherwise(0)
    )
    return signals.select("image_id", base.alias("tiene_edicion_local"), F.when(base & (score <= 2), "MEDIO").when(base, "ALTO").otherwise("BAJO").alias("nivel"))


def flagged_diff_tiles(diff: DataFrame, stats: DataFrame, share: float = 0.10, peak: float = 60.0) -> DataFrame:
    """Tiles of a difference plane with enough pixels over the robust threshold and a high peak."""
    t = diff.join(stats.select("image_id", "umbral_robusto"), "image_id")
    over = F.size(F.filter("px", lambda v: v > F.col("umbral_robusto"))) / F.size("px")
    tiles = t.select("image_id", "ty", "tx", over.alias("proporcion"), F.array_max("px").cast("double").alias("pico"))
    return tiles.where((F.col("proporcion") >= share) & (F.col("pico") >= peak))


def focused_diff(clusters: DataFrame, on_text: DataFrame, share: float = 0.10, peak: float = 60.0) -> DataFrame:
    """Edited when a compact cluster lies on text with a peak; urgent with digits or high intensity.

    clusters: tile_clusters with proporcion_media and pico per cluster; on_text: clusters_on_text.
    """
    c = clusters.where("localizado").join(on_text, ["image_id", "cluster_id"], "left")
    text = F.coalesce("cajas_texto", F.lit(0)) > 0
    g = c.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.bool_or(text).alias("_t"),
        F.bool_or(text & (F.col("pico") >= peak)).alias("_p"),
        F.bool_or(F.coalesce("con_digitos", F.lit(False))).alias("_d"),
        F.bool_or((F.col("proporcion_media") >= share + 0.05) | (F.col("pico") >= peak + 20)).alias("_i"),
    )
    edited = F.col("_t") & F.col("_p")
    return g.select("image_id", "clusters", edited.alias("editada"), F.when(edited & (F.col("_d") | F.col("_i")), "PRIORITARIO").otherwise("SECUNDARIO").alias("nivel"))


# Thresholds of each policy.
POLICIES = {
    "strict": {"boxes": 40, "cv": 0.45, "halo": 0.50, "outlier": 0.07, "density": 0.15, "ela": 10.0},
    "balanced": {"boxes": 30, "cv": 0.55, "halo": 0.45, "outlier": 0.05, "density": 0.12, "ela": 8.0},
    "lenient": {"boxes": 25, "cv": 0.65, "halo": 0.42, "outlier": 0.04, "density": 0.10, "ela": 7.0},
}


def flattened_policy(signals: DataFrame, policy: str = "balanced") -> DataFrame:
    """Flattened text, noise and localisation together, under one of three policies and the context.

    signals: image_id, sintetico, cajas, trazo, trazo_sd, puro, halo, outliers, localizado, agrupado,
    densidad, ela_region, ela_global, montos boolean, captura boolean, dpi int.
    """
    p = POLICIES[policy]
    screen = F.coalesce("captura", F.lit(False))
    coarse = F.coalesce((F.col("dpi") > 0) & (F.col("dpi") < 120), F.lit(False))
    shift = lambda base, test, by: F.when(test, base + by).otherwise(base)
    halo_limit = F.lit(p["halo"]) + F.when(screen, 0.03).otherwise(0.0) + F.when(coarse, 0.02).otherwise(0.0)
    cv = F.when(F.col("trazo") > 1e-6, F.col("trazo_sd") / F.col("trazo")).otherwise(999.0)
    many = F.col("cajas") >= p["boxes"]
    text = F.col("sintetico") | (many & (cv <= p["cv"])) | (many & F.col("puro"))
    noise = (F.col("halo") >= halo_limit) & (F.col("outliers") > shift(p["outlier"], screen, 0.01))
    local = F.col("localizado") | F.col("agrupado") | (F.col("densidad") >= shift(p["density"], screen, 0.02))
    ela = F.col("ela_region") >= shift(p["ela"], coarse, 2.0)
    score = (
        F.when(text, 25).otherwise(0) + F.when(noise, 25).otherwise(0) + F.when(local, 20).otherwise(0)
        + F.when(ela, 10).when(F.col("ela_global") >= 8.0, 4).otherwise(0) + F.when(F.col("montos"), 10).otherwise(0)
    )
    every = text & noise & local
    return signals.select(
        "image_id", score.alias("puntaje"), every.alias("prioritario"), F.when((score >= 70) | every, "PRIORITARIO").when(score >= 45, "MEDIO").otherwise("BAJO").alias("nivel")
    )


def screenshot(signals: DataFrame) -> DataFrame:
    """Screen captures: round resolution, many lines, no camera record and several text boxes.

    signals: image_id, width, height, densidad_lineas, exif_vacio, cajas, uniforme, brilla, puro, gradiente, patron.
    """
    round_size = F.col("width").isin(900, 1080, 1200, 1600) & F.col("height").isin(600, 900, 1200, 1600, 1920)
    shot = round_size & (F.col("densidad_lineas") > 0.2) & F.col("exif_vacio") & (F.col("cajas") > 5)
    coherent = F.col("uniforme") & F.col("brilla") & (F.col("puro") | F.col("gradiente"))
    found = F.when(shot, coherent).otherwise(coherent | ((F.col("densidad_lineas") > 0.15) & F.col("patron")))
    return signals.select(
        "image_id", shot.alias("es_captura"), found.alias("tiene_texto_sintetico"), F.when(found & shot, "MEDIO").when(found, "ALTO").otherwise("BAJO").alias("nivel")
    )


# Evidence points by analysis and level, with the maximum that analysis can give.
CONFIDENCE_POINTS = {
    "ela": ({"ALTO": 3, "MEDIO": 2}, 1, 3),
    "doble_compresion": ({"ALTA": 3, "MEDIA": 2}, 1, 3),
    "ruido_bordes": ({"ALTO": 2, "MEDIO": 1}, 0, 2),
    "phash_bloques": ({"ALTO": 2, "MEDIO": 1}, 0, 2),
    "ssim_regional": ({"ALTO": 2, "MEDIO": 1}, 0, 2),
}


def confidence(evidence: DataFrame) -> DataFrame:
    """(image_id, analisis, detectado, nivel) to a grade: points over the maximum of the analyses run."""
    points, top = F.lit(0), F.lit(0)
    for name, (by_level, other, most) in CONFIDENCE_POINTS.items():
        here = F.col("analisis") == name
        value = F.lit(other)
        for level, p in by_level.items():
            value = F.when(F.col("nivel") == level, p).otherwise(value)
        points = points + F.when(here & F.col("detectado"), value).otherwise(0)
        top = top + F.when(here, most).otherwise(0)
    g = evidence.groupBy("image_id").agg(F.sum(points).alias("puntos"), F.sum(top).alias("maximo"))
    pct = F.when(F.col("maximo") > 0, F.col("puntos") / F.col("maximo") * 100).otherwise(0.0)
    return g.select("image_id", "puntos", "maximo", F.round(pct, 1).alias("porcentaje"), F.when(pct >= 70, "ALTO").when(pct >= 40, "MEDIO").otherwise("BAJO").alias("grado"))


def confidence_consolidated(signals: DataFrame) -> DataFrame:
    """Second scheme with a fixed maximum of 33 points and milder rules for screen captures.

    signals: image_id, software (0 none, 1 named, 3 editor), fechas (0, 1, 3), app boolean, splicing
    boolean, cortes int, sintetico, captura, densidad_lineas, trazo_uniforme, ela (null or level), ruido,
    halo, hashes int, overlays int.
    """
    spliced = F.col("splicing") | F.col("sintetico")
    text = (
        F.when(F.col("sintetico"), F.when(F.col("captura"), 2).otherwise(5))
        .when((F.col("densidad_lineas") > 0.15) | F.col("trazo_uniforme"), F.when(F.col("captura"), 0).otherwise(2))
        .otherwise(0)
    )
    points = (
        F.col("software") + F.col("fechas") + F.when(F.col("app"), 2).otherwise(0) + F.when(F.col("splicing"), 4).when(F.col("cortes") > 2, 2).otherwise(0)
        + text + F.when(F.col("ela") == "ALTO", 3).when((F.col("ela") == "MEDIO") & spliced, 2).otherwise(0)
        + F.when(F.col("ruido") & spliced, 2).otherwise(0) + F.when(F.col("halo") & spliced, 2).otherwise(0) + F.col("hashes")
        + F.when(F.col("overlays") > 0, F.least(F.lit(5), F.col("overlays") + 2)).otherwise(0)
    )
    # 5 + 3 + 2 + 4 + 5 + 3 + 2 + 2 + 2 + 5 points over the ten kinds of evidence
    pct = points / 33.0 * 100
    grade = F.when(F.col("captura") & (pct < 30), "BAJO").when(pct > 70, "ALTO").when(pct > 40, "MEDIO").otherwise("BAJO")
    return signals.select("image_id", points.cast("bigint").alias("puntos"), F.round(pct, 1).alias("porcentaje"), grade.alias("grado"))


def manipulation_probability(signals: DataFrame) -> DataFrame:
    """Metadata 0.2, overlaid text 0.3, hidden layers 0.2 and the forensic grade 0.5/0.3/0.1.

    signals: image_id, metadatos, bordes_rectos, uniforme, patron_texto, capas_ocultas int, grado.
    """
    overlay = F.when(F.col("bordes_rectos"), 0.3).otherwise(0.0) + F.when(F.col("uniforme"), 0.2).otherwise(0.0) + F.when(F.col("patron_texto"), 0.4).otherwise(0.0)
    p = F.least(
        F.lit(1.0),
        F.when(F.col("metadatos"), 0.2).otherwise(0.0) + F.when(overlay > 0.5, 0.3).otherwise(0.0) + F.when(F.col("capas_ocultas") > 0, 0.2).otherwise(0.0)
        + F.when(F.col("grado") == "ALTO", 0.5).when(F.col("grado") == "MEDIO", 0.3).when(F.col("grado").isNotNull(), 0.1).otherwise(0.0),
    )
    p = F.round(p, 4)
    return signals.select("image_id", F.round(overlay, 4).alias("superposicion"), p.alias("probabilidad"), F.when(p >= 0.7, "HIGH").when(p >= 0.4, "MEDIUM").otherwise("LOW").alias("nivel"))


def image_suspicion(signals: DataFrame, variant: str = "full") -> DataFrame:
    """0-100 suspicion of an image from its sub-scores.

    signals: image_id, razon, outliers, p95, pendiente, copia (combined or density score), overlays,
    fuentes boolean, capas_pdf boolean, montos_coherentes (null = unknown), editor, exif, fechas points.
    Variants: `full`; `document` without overlays, layers and dates; `advanced` without overlays,
    layers and amounts. The last two weigh copies with 22 instead of 15.
    """
    slope = F.col("pendiente")
    s = F.when(slope >= 0, ramp(F.lit(0.08) - slope, 0.0, 0.08, 8)).otherwise(ramp(F.abs(slope), 0.0, 0.1, 8))
    parts = {
        "razon": ramp(F.col("razon"), 0.6, 1.2, 25),
        "atipicos": ramp(F.col("outliers"), 0.0, 0.15, 20),
        "intensidad": ramp(F.col("p95") / 255.0, 0.12, 0.28, 10),
        "calidad": s,
        "copia": F.col("copia") * (15.0 if variant == "full" else 22.0),
        "software": F.when(F.col("editor"), 5.0).when(F.col("exif"), 0.0).otherwise(2.0),
    }
    if variant == "full":
        parts["texto"] = F.when(F.col("overlays") >= 3, 8.0).when(F.col("overlays") >= 1, 4.0).otherwise(0.0) + F.when(F.col("fuentes"), 3.0).otherwise(0.0)
        parts["capas"] = F.when(F.col("capas_pdf"), 5.0).otherwise(0.0)
    if variant != "advanced":
        parts["montos"] = F.when(~F.col("montos_coherentes"), 10.0).otherwise(0.0)
    if variant != "document":
        parts["fechas"] = F.col("fechas").cast("double")
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(parts.values(), F.lit(0.0))))
    return signals.select("image_id", F.round(total, 2).alias("sospecha"), suspicion_label(total).alias("etiqueta"), *[F.round(v, 2).alias(f"p_{n}") for n, v in parts.items()])


# Penalties of the image checks, by section.
IMAGE_CHECKS = [
    ("prioritarias", "sri", 15), ("prioritarias", "texto_sintetico", 20), ("prioritarias", "ruido", 18), ("prioritarias", "ela", 12),
    ("secundarias", "doble_compresion", 8), ("secundarias", "hashes", 10), ("adicionales", "metadatos", 5),
]


def image_risk_checks(flags: DataFrame) -> DataFrame:
    """Check rows from one row of booleans per image; `sri` fires when the document is not verified."""
    from cotejo.operators.scoring import explode_checks

    fired = lambda n: ~F.col("sri_verificado") if n == "sri" else F.col(n)
    return explode_checks(flags, ["image_id"], [(s, n, fired(n), F.when(fired(n), p).otherwise(0)) for s, n, p in IMAGE_CHECKS])


def image_risk(flags: DataFrame) -> DataFrame:
    """Score and level of an invoice image: high from 80, medium from 50."""
    from cotejo.operators.scoring import score_documents

    s = score_documents(image_risk_checks(flags), ["image_id"])
    return s.select("image_id", "score", F.when(F.col("score") >= 80, "alto").when(F.col("score") >= 50, "medio").otherwise("bajo").alias("nivel"), (F.col("score") >= 80).alias("es_falso_probable"))
