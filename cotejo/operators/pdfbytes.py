"""Signals read straight from document bytes: markers, counts, signatures.

Every operator here drops the content column, so no later join or shuffle carries file bodies.
`window` limits a scan to the leading bytes; the default reads the whole body.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.text import contains_any, extract, extract_all

TEXT_MIN_LENGTH = 50
PAGE_MIN_BYTES, PAGE_MAX_TEXT, PAGE_MAX_SCANNED = 20_000, 1_200_000, 3_500_000

# Names that mark a known producing program.
KNOWN_PRODUCERS = [
    "adobe", "itext", "apache pdfbox", "libreoffice", "microsoft", "wkhtmltopdf", "reportlab", "foxit", "tcpdf",
    "aspose", "prince", "weasyprint",
]


def as_text(content: Column, window: int | None = None) -> Column:
    """Bytes one to one as Latin-1 characters."""
    return F.decode(F.substring(content, 1, window) if window else content, "ISO-8859-1")


def is_scanned(raw_docs: DataFrame, doc_text: DataFrame, window: int | None = None) -> DataFrame:
    """Little text and at least one image object."""
    t = as_text(F.col("content"), window)
    images = raw_docs.select("doc_id", t.rlike(r"/Subtype\s*/Image|/Image\b").alias("_img"))
    text = doc_text.groupBy("doc_id").agg(F.max(F.length(F.trim("text"))).alias("_len"))
    return images.join(text, "doc_id", "left").select(
        "doc_id", (F.col("_img") & (F.coalesce("_len", F.lit(0)) < TEXT_MIN_LENGTH)).alias("escaneado")
    )


def size_check(docs: DataFrame) -> DataFrame:
    """(doc_id, size_bytes, pages, escaneado) to whether the size per page is plausible."""
    per_page = F.col("size_bytes") / F.col("pages")
    top = F.when(F.col("escaneado"), PAGE_MAX_SCANNED).otherwise(PAGE_MAX_TEXT)
    one = F.col("pages") == 1
    limit = F.when(one, top).otherwise(top * 1.5)
    floor = F.when(one, F.lit(float(PAGE_MIN_BYTES))).otherwise(PAGE_MIN_BYTES * 0.6)
    has_pages = F.col("pages") > 0
    return docs.select(
        "doc_id",
        F.when(has_pages, (per_page >= floor) & (per_page <= limit)).otherwise(True).alias("ok"),
        F.when(has_pages, per_page.cast("bigint")).alias("bytes_por_pagina"),
        F.when(has_pages, limit.cast("bigint")).alias("limite_max"),
        F.when(F.col("escaneado"), "escaneado").otherwise("textual").alias("tipo"),
    )


def pdf_markers(raw_docs: DataFrame, window: int | None = None) -> DataFrame:
    t = as_text(F.col("content"), window)
    return raw_docs.select(
        "doc_id",
        contains_any(t, ["/JavaScript", "/JS"]).alias("has_js"),
        contains_any(t, ["/EmbeddedFiles", "/FileAttachment"]).alias("has_embedded"),
        contains_any(t, ["/AcroForm", "/Annots"]).alias("has_forms"),
    )


def pdf_counts(raw_docs: DataFrame) -> DataFrame:
    t = as_text(F.col("content"))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    starts, eofs = n("startxref"), n("%%EOF")
    return raw_docs.select(
        "doc_id",
        starts.alias("startxref"),
        eofs.alias("eof"),
        n("/XObject").alias("xobjects"),
        contains_any(t, ["/OCG", "/OCProperties"]).alias("has_ocg"),
        ((starts > 1) | (eofs > 1)).alias("incremental"),
    )


def producer_ok(pdf_meta: DataFrame, literal: bool = False) -> DataFrame:
    """Known producer or creator; `literal` gives the rule that passes nearly everything."""
    joined = F.lower(F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit(""))))
    if literal:
        same = F.col("producer").eqNullSafe(F.col("creator")) & F.col("creator").eqNullSafe(F.col("author"))
        ok = same | ~F.col("creator").eqNullSafe(F.lit("")) | F.col("author").eqNullSafe(F.lit(""))
    else:
        ok = contains_any(joined, KNOWN_PRODUCERS)
    return pdf_meta.select("doc_id", ok.alias("productor_conocido"))


# Layer tokens looked for in any file.
LAYER_TOKENS = ["/OC", "/XObject", "/Form", "/Group", "/Transparency", "/Layer"]


def pdf_layer_tokens(raw_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    t = as_text(F.col("content"))
    kinds = F.array_compact(F.array(*[F.when(t.contains(tok), tok) for tok in LAYER_TOKENS]))
    streams = F.regexp_count(t, F.lit("stream")).cast("bigint")
    return raw_docs.select(
        id_col,
        F.concat_ws(",", kinds).alias("tokens"),
        F.size(kinds).alias("n_tokens"),
        streams.alias("streams"),
        F.regexp_count(t, F.lit("endstream")).cast("bigint").alias("endstreams"),
        ((F.size(kinds) > 2) | (streams > 5)).alias("sospechoso"),
    )


_NUM = r"(\d+\.?\d*)"


def _command(kind: str, match: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), match.alias("command"))


def stream_commands(streams: DataFrame) -> DataFrame:
    """Text, rectangle, colour and cover-up commands of uncompressed content streams, one row each."""
    t = as_text(F.col("body"))
    sep = r"\s+"
    rect = sep.join([_NUM] * 4) + r"\s+re\s+f"
    patterns = [
        ("texto", r"(?s)BT\s+(.*?)\s+ET"),
        ("rectangulo", rect),
        ("color", sep.join([_NUM] * 3) + r"\s+rg"),
        ("tapado", "(?s)" + sep.join([_NUM] * 4) + r"\s+re\s+1\s+1\s+1\s+rg\s+f\s+.*?BT\s+.*?Tj\s+ET"),
    ]
    found = F.flatten(
        F.array(
            *[
                F.transform(extract_all(t, p, 1 if kind == "texto" else 0), partial(_command, kind))
                for kind, p in patterns
            ]
        )
    )
    return streams.select("doc_id", "page", "stream_no", F.posexplode(found).alias("cmd_no", "_c")).select(
        "doc_id", "page", "stream_no", "cmd_no", "_c.*"
    )


# Signature patterns and what each adds to the confidence.
SIGNATURE_PATTERNS = [
    ("byterange", r"/ByteRange\s*\[", 0.4),
    ("sig", r"/Sig\b", 0.2),
    ("digital", r"/DigitalSignature\b", 0.2),
    ("contents", r"/Contents\s*<[0-9A-Fa-f\s]+>", 0.3),
    ("subfilter", r"/SubFilter\s*/", 0.1),
    ("location", r"/Location\s*\(", 0.05),
    ("reason", r"/Reason\s*\(", 0.05),
    ("name", r"/Name\s*\(", 0.05),
]


def signature_patterns(raw_docs: DataFrame) -> DataFrame:
    """Counts of eight patterns, detection, confidence and type of signature."""
    t = as_text(F.col("content"))
    df = raw_docs.select(
        "doc_id",
        *[F.regexp_count(t, F.lit(p)).cast("bigint").alias(f"n_{n}") for n, p, _ in SIGNATURE_PATTERNS],
        extract(t, r"/SubFilter\s*/([A-Za-z0-9.\-]+)").alias("subfilter"),
        extract(t, r"/Location\s*\(([^)]+)\)").alias("location"),
        extract(t, r"/Reason\s*\(([^)]+)\)").alias("reason"),
        extract(t, r"/Name\s*\(([^)]+)\)").alias("name"),
        extract(t, r"/M\s*\(([^)]+)\)").alias("signing_date"),
        extract(t, r"/ContactInfo\s*\(([^)]+)\)").alias("contact_info"),
    )
    confidence = F.lit(0.0)
    for n, _, weight in SIGNATURE_PATTERNS:
        confidence = confidence + F.when(F.col(f"n_{n}") > 0, weight).otherwise(0.0)
    sub = F.coalesce("subfilter", F.lit(""))
    kind = (
        F.when(F.col("n_byterange") == 0, "ninguna")
        .when(sub == "adbe.pkcs7.detached", "adobe_pkcs7")
        .when(F.lower(sub).contains("pades"), "pades")
        .when(F.lower(sub).contains("xades"), "xades")
        .when(F.col("name").isNotNull() & F.col("reason").isNotNull(), "avanzada")
        .when(F.col("n_contents") > 0, "basica")
        .otherwise("indeterminada")
    )
    detected = (F.col("n_byterange") > 0) | (F.col("n_sig") > 0) | (F.col("n_digital") > 0) | (F.col("n_contents") > 0)
    return df.withColumn("firma_detectada", detected).withColumn("tipo_firma", kind).withColumn(
        "confianza", F.round(F.least(F.lit(1.0), confidence), 4)
    )


# Literal byte patterns that count as signature evidence.
SIGNATURE_LITERALS = [
    "/Sig", "/DigitalSignature", "/ByteRange", "/Contents", "/Filter/Adobe.PPKMS", "/Filter/Adobe.PPKLite",
    "/SubFilter/adbe.pkcs7.detached", "/SubFilter/adbe.pkcs7.sha1", "/SubFilter/ETSI.CAdES.detached", "/Type/Sig",
]


def signature_bytes(raw_docs: DataFrame, window: int | None = None) -> DataFrame:
    t = as_text(F.col("content"), window)
    hits = F.array_compact(F.array(*[F.when(t.contains(x), x) for x in SIGNATURE_LITERALS]))
    n = lambda x: F.regexp_count(t, F.lit(x)).cast("bigint")
    return raw_docs.select(
        "doc_id",
        (F.size(hits) > 0).alias("firma_detectada"),
        F.greatest(n("/Sig"), n("/ByteRange")).alias("cantidad_firmas"),
        F.concat_ws(",", hits).alias("patrones"),
    )


_BYTE_RANGE = r"/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\]"


def signature_integrity(raw_docs: DataFrame, max_gap: int = 100_000) -> DataFrame:
    """Several cross-reference tables or a wide hole between signed ranges mean a changed document."""
    t = as_text(F.col("content"))
    parts = [F.transform(extract_all(t, _BYTE_RANGE, g), lambda x: x.try_cast("bigint")) for g in (1, 2, 3)]
    gaps = F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]), lambda z: z["g2"] - (z["g0"] + z["g1"]))
    xrefs = F.regexp_count(t, F.lit("xref")).cast("bigint")
    wide = F.size(F.filter(gaps, lambda g: g > max_gap)).cast("bigint")
    return raw_docs.select(
        "doc_id", xrefs.alias("xref"), wide.alias("huecos"), ((xrefs <= 1) & (wide == 0)).alias("documento_integro")
    )


def _nearest(before: Column, after: Column, pattern: str) -> Column:
    """Group 1 of the match nearest to the place between the two texts; the later one of two as near."""
    last, first = r"(?s)^.*" + pattern, F.regexp_instr(after, F.lit(pattern)) - 1
    way_back = F.length(before) - F.length(F.regexp_extract(before, last, 0))
    later, earlier = extract(after, pattern), extract(before, last)
    return F.when(later.isNotNull() & (earlier.isNull() | (first <= way_back)), later).otherwise(earlier)


def find_signatures(raw_docs: DataFrame, distance: int | None = None) -> DataFrame:
    """One row per signed byte range; `con_contenido` tells whether readable contents belong to it.

    Contents, filter name, location, reason and name are the nearest in the range's own PDF object, or in the whole body where no
    object encloses the range. `distance` limits the search to so many characters around the range.
    """
    t = as_text(F.col("content"))
    df = raw_docs.select("doc_id", F.length("content").cast("bigint").alias("size_bytes"), t.alias("_t"))
    df = df.where(F.col("_t").rlike(_BYTE_RANGE))
    lens = F.transform(extract_all(F.col("_t"), _BYTE_RANGE, 0), lambda m: F.length(m))
    gaps = F.transform(F.split("_t", _BYTE_RANGE), lambda p: F.length(p))
    zipped = F.arrays_zip(
        lens.alias("len"), gaps.alias("gap"), *[extract_all(F.col("_t"), _BYTE_RANGE, g).alias(f"b{g}") for g in (1, 2, 3, 4)]
    )
    # a match starts after all earlier gaps and matches
    placed = F.transform(
        zipped,
        lambda z, i: z.withField(
            "start", F.aggregate(F.slice(zipped, F.lit(1), i), F.lit(0), lambda a, y: a + y["len"] + y["gap"]) + z["gap"]
        ),
    )
    real = F.filter(placed, lambda z: z["len"].isNotNull())
    rows = df.select("doc_id", "size_bytes", "_t", F.posexplode(real).alias("sig_no", "_m"))
    start, stop = F.col("_m.start"), F.col("_m.start") + F.col("_m.len")
    before, after = F.substr("_t", F.lit(1), start), F.substr("_t", stop + 1)
    if distance is not None:
        before, after = F.right(before, F.lit(distance)), F.left(after, F.lit(distance))
    # the object that encloses the range begins after the last `obj` that no `endobj` follows
    opened = F.substring_index(before, " obj", -1)
    enclosed = before.contains(" obj") & ~opened.contains("endobj") & after.contains("endobj")
    cut = rows.select(
        "*", F.when(enclosed, opened).otherwise(before).alias("_b"), F.when(enclosed, F.substring_index(after, "endobj", 1)).otherwise(after).alias("_a")
    )
    own = partial(_nearest, F.col("_b"), F.col("_a"))
    digits = F.regexp_replace(own(r"/Contents\s*<([0-9A-Fa-f\s]+)>"), r"[ \n]", "")
    return cut.select(
        "doc_id",
        "sig_no",
        *[F.col(f"_m.b{g}").try_cast("bigint").alias(f"br{g - 1}") for g in (1, 2, 3, 4)],
        own(r"/SubFilter\s*/([A-Za-z0-9.\-]+)").alias("subfilter"),
        own(r"/Location\s*\(([^)]+)\)").alias("location"),
        own(r"/Reason\s*\(([^)]+)\)").alias("reason"),
        own(r"/Name\s*\(([^)]+)\)").alias("name"),
        (F.col("_m.b3").try_cast("bigint") + F.col("_m.b4").try_cast("bigint") != F.col("size_bytes")).alias("modificada"),
        F.coalesce((F.length(digits) % 2 == 0) & ~digits.rlike(r"\s"), F.lit(False)).alias("con_contenido"),
    )


def signature_summary(signatures: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per document: signatures, intact digests, unmodified, verified, trusted, PAdES and valid ones."""
    s = signatures.join(sizes.select("doc_id", "size_bytes"), "doc_id")
    intact = F.coalesce("digest_match", F.lit(False))
    unmodified = F.col("br2") + F.col("br3") == F.col("size_bytes")
    pades = F.lower("subfilter").rlike("cades|pades")
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_firmas"),
        F.count_if(intact).alias("integridad_ok"),
        F.count_if(unmodified).alias("sin_modificaciones"),
        F.count_if(F.coalesce("crypto_ok", F.lit(False))).alias("crypto_ok"),
        F.count_if(F.coalesce("chain_ok", F.lit(False))).alias("chain_ok"),
        F.count_if(F.coalesce(pades, F.lit(False))).alias("pades"),
        F.count_if(intact & unmodified).alias("firmas_validas"),
    )


# Organisations whose certificates are trusted roots.
TRUSTED_ISSUERS = ["banco central", "bce", "security data"]


def certificate_info(raw_docs: DataFrame) -> DataFrame:
    """Certificate-like strings, signature standards and the PDF version."""
    t = as_text(F.col("content"))
    org = F.trim(extract(t, r"(?i)O=([^,]+)"))
    return raw_docs.select(
        "doc_id",
        F.trim(extract(t, r"(?i)CN=([^,]+)")).alias("emisor"),
        org.alias("organizacion"),
        extract(t, r"(?i)C=([A-Z]{2})").alias("pais"),
        F.trim(extract(t, r"(?i)emailAddress=([^,]+)")).alias("email"),
        F.trim(extract(t, r"(?i)notBefore=([^,]+)")).alias("fecha_inicio"),
        F.trim(extract(t, r"(?i)notAfter=([^,]+)")).alias("fecha_fin"),
        F.coalesce(contains_any(F.lower(org), TRUSTED_ISSUERS), F.lit(False)).alias("raiz_valida"),
        extract(as_text(F.col("content"), 10000), r"%PDF-(\d\.\d)").alias("pdf_version"),
        t.contains("Adobe.PPKLite").alias("adobe_signature"),
        t.contains("adbe.pkcs7.detached").alias("pkcs7_detached"),
        t.contains("ETSI.CAdES").alias("pades_compatible"),
    )


def signature_security(facts: DataFrame) -> DataFrame:
    """Level and weaknesses from firmas_validas, firmas_invalidas, cantidad_firmas, documento_integro, raiz_valida."""
    valid, invalid = F.col("firmas_validas") > 0, F.col("firmas_invalidas") > 0
    intact = F.col("documento_integro")
    level = F.when(invalid, "bajo").when(valid & intact, "alto").when(valid, "medio").otherwise("bajo")
    weak = F.array_compact(
        F.array(
            F.when(valid & ~intact, "modificado_tras_firma"),
            F.when(~F.col("raiz_valida"), "autoridad_no_confiable"),
            F.when(F.col("cantidad_firmas") > 3, "demasiadas_firmas"),
            F.when(invalid, "firmas_invalidas"),
        )
    )
    return facts.select("doc_id", level.alias("nivel_seguridad"), F.concat_ws(",", weak).alias("vulnerabilidades"), F.size(weak).alias("n_vulnerabilidades"))


def pdf_suspicion(facts: DataFrame) -> DataFrame:
    """0-100 suspicion of a PDF from counts, metadata presence, text presence and amount coherence.

    `facts`: doc_id, startxref, eof, xobjects, has_ocg, incremental, has_meta, error, has_text,
    amounts_consistent (null = unknown).
    """
    add = lambda test, points: F.when(test, points).otherwise(0)
    score = (
        add(F.col("incremental"), 25)
        + add(F.col("startxref") > 1, 20)
        + add(F.col("eof") > 1, 15)
        + add(F.col("has_ocg"), 15)
        + add(F.col("xobjects") > 20, 10)
        + add(~F.col("has_meta"), 8)
        + add(F.col("error"), 5)
        + add(~F.col("has_text"), 10)
        + add(F.coalesce(~F.col("amounts_consistent"), F.lit(False)), 15)
    )
    total = F.least(F.lit(100), score)
    return facts.select("doc_id", total.alias("sospecha"), suspicion_label(total).alias("etiqueta"))


def suspicion_label(score: Column) -> Column:
    return F.when(score < 25, "baja").when(score < 50, "media").when(score < 75, "alta").otherwise("muy_alta")
