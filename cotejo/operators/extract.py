"""Fields, amounts, items and identifiers from document text.

Each operator reads (doc_id, text) and stays inside the row: no shuffle, and a long document is
one long row rather than a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.binding import let
from cotejo.functions.ids import cedula_ok, first_dated, key_valid, key_windows, repair_key, repair_key_swaps, ruc_ok
from cotejo.functions.numbers import as_double, norm_amount, normalize_decimal, to_float, truthy
from cotejo.functions.text import (
    collapse_spaces, contains_any, digits_only, extract, extract_all, extract_first, lines_of, ocr_digits, strip,
    strip_accents, strip_zero_width,
)

# ---------------------------------------------------------------- access key

# Labels that announce an access key.
KEY_LABELS = [
    r"\bCLAVE\s*DE\s*ACCESO\s*DOCUMENTO\s*ELECTRONICO\b",
    r"\bCLAVE\s*ACCESO\s*DOCUMENTO\s*ELECTRONICO\b",
    r"\bCLAVE\s*DE\s*ACCESO\b",
    r"\bCLAVE\s*ACCESO\b",
]
_SPACED49 = r"(?:\d[\s-]*){49}"


def _first_49(candidates: Column) -> Column:
    """First candidate that has exactly 49 digits."""
    return F.get(F.filter(F.transform(candidates, digits_only), lambda d: F.length(d) == 49), F.lit(0))


def _digits_of(pattern: str, window: Column) -> Column:
    return digits_only(F.regexp_extract(window, pattern, 1))


def _windows(text: Column, label: str, size: int | None = None) -> Column:
    """The text after every hit of a label up to the next hit, or its first `size` characters."""
    pieces = F.split(text, label)
    # joining the later pieces restores the running text after a hit, up to other hits of the label
    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    return after if size is None else F.transform(after, lambda p: F.substring(p, 1, size))


def access_key(doc_text: DataFrame) -> DataFrame:
    """First run of 49 digits, else a lone run of 48, else spaced digits after a label.

    In a longer run only a window with a valid check digit counts; `sin_valida` tells that there was such a run and no key.
    """
    t = F.regexp_replace(strip_accents(F.col("text")), r"[ \t]+", " ")
    df = doc_text.select("doc_id", t.alias("_t"))
    long = extract_all(F.col("_t"), r"\d{49,}")
    plain = F.get(F.filter(F.transform(long, _key_of_run), lambda k: k.isNotNull()), F.lit(0))
    run48 = F.get(F.filter(extract_all(F.col("_t"), r"\d{40,}"), lambda s: F.length(s) == 48), F.lit(0))
    tries = [plain, run48]
    for label in KEY_LABELS:
        spans = _windows(F.col("_t"), "(?i)" + label)
        spaced = F.transform(spans, lambda w: F.regexp_extract(w, f"({_SPACED49})", 1))
        loose = F.transform(spans, lambda w: F.regexp_extract(w, r"(\d+(?:\s+\d+)*)", 1))
        tries += [_first_49(spaced), _first_49(loose)]
    tail = _windows(F.col("_t"), r"(?i)DOCUMENTO\s*ELECTRONICO")
    for pattern in (f"({_SPACED49})", r"(\d{48,50})", r"(\d+(?:\s+\d+)*)"):
        found = F.transform(tail, partial(_digits_of, pattern))
        tries.append(F.get(F.filter(found, lambda d: F.length(d).isin(48, 49)), F.lit(0)))
    found = df.select("doc_id", F.coalesce(*tries).alias("clave"), (F.size(long) > 0).alias("_long"))
    return found.select("doc_id", "clave", (F.col("clave").isNull() & F.coalesce("_long", F.lit(False))).alias("sin_valida"))


def _key_of_run(run: Column) -> Column:
    """A run of 49 digits as it stands; of a longer one a window with a valid check digit, dated ones first, else null."""
    valid = F.filter(key_windows(run), key_valid)
    return F.when(F.length(run) == 49, run).otherwise(let(valid, lambda v: F.coalesce(first_dated(v), F.get(v, F.lit(0)))))


def _ocr_text(c: Column) -> Column:
    return strip_zero_width(ocr_digits(c, "capture"))


# Fixed values.
_AUTH_HEADER = r"(?i)(?:N[ÚU]MER[O0]\s+DE\s+AUT[O0]R[I1]ZAC[I1][ÓO0]N|AUT[O0]R[I1]ZAC[I1][ÓO0]N|CLAVE\s+DE\s+ACCE[S5][O0])"
#: what lies between runs of digits; up to two separators stay inside a run
_BETWEEN_RUNS = r"[^\d\s\-.]+|[\s\-.]{3,}"


def access_key_ocr(doc_text: DataFrame) -> DataFrame:
    """Key from recognised text: digit look-alikes mapped, any 49-digit window with a valid check digit wins.

    Windows that begin with a date go first, then those of the longest run, then runs after the header. Without a valid window the
    key is null, and `sin_valida` tells that there was a run of 49 digits or more.
    """
    df = doc_text.select("doc_id", _ocr_text(F.col("text")).alias("_t"))
    after = F.get(_windows(F.col("_t"), _AUTH_HEADER), F.lit(0))
    runs = F.concat(F.split(F.coalesce(after, F.lit("")), _BETWEEN_RUNS), F.split("_t", _BETWEEN_RUNS))
    # most runs are too short to hold a key, so their digits are never picked out
    digits = F.filter(F.transform(F.filter(runs, lambda r: F.length(r) >= 49), digits_only), lambda d: F.length(d) >= 49)
    # stable order by length: position breaks ties
    ranked = F.transform(
        F.array_sort(F.transform(digits, lambda d, i: F.struct((-F.length(d)).alias("k"), i.alias("i"), d.alias("d")))), lambda s: s["d"]
    )
    # the text after the header is part of the text, so windows come twice
    valid = F.filter(F.array_distinct(F.flatten(F.transform(ranked, key_windows))), key_valid)
    found = df.select("doc_id", let(valid, lambda v: F.coalesce(first_dated(v), F.get(v, F.lit(0)))).alias("clave"), (F.size(digits) > 0).alias("_long"))
    return found.select("doc_id", "clave", (F.col("clave").isNull() & F.coalesce("_long", F.lit(False))).alias("sin_valida"))


def access_key_form(doc_text: DataFrame) -> DataFrame:
    """Key of a printed form: the labelled run and then any long run, each repaired by digit swaps in every window.

    `sin_valida` tells that there was such a run but no valid key.
    """
    t = F.col("text")
    labelled = F.regexp_extract(t, r"(?i)(?:Clave.*Acceso|N[uú]mero de autorizaci[oó]n)[:\s]*([0-9\s]{45,})", 1)
    runs = F.concat(F.array(labelled), extract_all(t, r"\d[\d\s]{47,}\d"))
    # the labelled run is mostly one of the long ones; each is repaired once
    different = F.array_distinct(F.transform(runs, lambda r: digits_only(ocr_digits(r, "pdf"))))
    fixed = F.filter(F.transform(different, repair_key_swaps), lambda k: k.isNotNull())
    long = F.exists(runs, lambda r: F.length(digits_only(r)) >= 49)
    found = doc_text.select("doc_id", F.get(fixed, F.lit(0)).alias("clave"), long.alias("_long"))
    return found.select("doc_id", "clave", (F.col("clave").isNull() & F.coalesce("_long", F.lit(False))).alias("sin_valida"))


def access_key_xml(sri_xml: DataFrame) -> DataFrame:
    """First element text of 49 letters or digits, else the first such attribute."""
    x = F.col("xml")
    in_text = extract(x, r">\s*([A-Za-z0-9]{49})\s*<")
    return sri_xml.select("clave", F.coalesce(in_text, extract(x, r"=[\"']([A-Za-z0-9]{49})[\"']")).alias("clave_xml"))


def repaired_key(keys: DataFrame) -> DataFrame:
    fixed = keys.select("doc_id", repair_key(F.col("clave")).alias("clave"))
    return fixed.withColumn("valida", key_valid(F.col("clave")))


def authorization_number(doc_text: DataFrame, attached: DataFrame) -> DataFrame:
    """49-digit numbers by precedence: close to a label, then in attached XML, then anywhere.

    `attached` is (doc_id, xml); several files of a document are merged by a set aggregate.
    """
    spaced = r"(?:\d[\s\-  ]*){49}"
    label = r"(?i)(?:n[uú]mero\s*de\s*autorizaci[oó]n|clave\s*de\s*acceso)"
    near = F.transform(_windows(F.col("text"), label), lambda w: digits_only(F.regexp_extract(w, f"({spaced})", 1)))
    anywhere = F.transform(extract_all(F.col("text"), spaced), digits_only)
    keep = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda d: F.length(d) == 49)))
    tag = r"(?i)<(?:numeroAutorizacion|claveAcceso)>(\d{49})</(?:numeroAutorizacion|claveAcceso)>"
    numbers = attached.select("doc_id", F.explode(extract_all(F.col("xml"), tag, 1)).alias("_n"))
    by_doc = numbers.groupBy("doc_id").agg(F.min("_n").alias("_xml"), F.count_distinct("_n").alias("_k"))
    text = doc_text.select("doc_id", keep(near).alias("_near"), keep(anywhere).alias("_any"))
    joined = text.join(by_doc, "doc_id", "left")
    source = (
        F.when(F.size("_near") > 0, "cerca_de_etiqueta")
        .when(F.col("_xml").isNotNull(), "en_adjuntos_xml")
        .when(F.size("_any") > 0, "en_texto_global")
    )
    return joined.select(
        "doc_id",
        F.coalesce(F.get("_near", F.lit(0)), F.col("_xml"), F.get("_any", F.lit(0))).alias("numero_autorizacion"),
        source.alias("origen"),
        F.when(F.size("_near") > 0, F.size("_near")).when(F.col("_xml").isNotNull(), F.col("_k")).otherwise(F.size("_any")).cast("bigint").alias("total_encontrados"),
    )


# ---------------------------------------------------------------- header fields


def _full_year(c: Column) -> Column:
    s = F.replace(c, F.lit("-"), F.lit("/"))
    short = s.rlike(r"/\d{2}$")
    return F.when(short, F.regexp_replace(s, r"/(\d{2})$", "/20$1")).otherwise(s)


def company_name(lines: Column) -> Column:
    """Up to three lines before the first line naming the taxpayer number, joined."""
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?i)\bRUC\b"), i)), lambda i: i.isNotNull()), F.lit(0))
    start = F.greatest(at - 3, F.lit(0))
    block = F.array_join(F.slice(lines, start + 1, F.greatest(at - start, F.lit(0))), " ")
    kept = F.regexp_replace(block, r"(?i)^(DIRECCION|SUCURSAL|MATRIZ).*$", "")
    return F.when(at > 0, collapse_spaces(kept))


def header_fields(doc_text: DataFrame) -> DataFrame:
    """Taxpayer number, issue date and company of an invoice text."""
    df = doc_text.select("doc_id", strip_accents(F.col("text")).alias("_t"))
    t = F.col("_t")
    date = r"([0-3]?\d[/-][01]?\d[/-]\d{2,4})"
    return df.select(
        "doc_id",
        extract_first(t, [r"(?i)\bRUC[:\s]*([0-9]{13})\b", r"\b([0-9]{13})\b"]).alias("ruc"),
        _full_year(extract_first(t, [r"(?i)fecha\s*(?:de\s*)?emision[:\s]*" + date, r"\b" + date + r"\b"])).alias("fechaEmision"),
        company_name(lines_of(t)).alias("razonSocial"),
    )


def capture_fields(doc_text: DataFrame) -> DataFrame:
    """Fields of a photographed invoice, tolerant of spacing."""
    t = F.col("text")
    number = r"([0-9]{3}-[0-9]{3}-[0-9]{9})"
    stamp = r"(\d{4}-\d{2}-\d{2}\s*\d{2}:\d{2}:\d{2})"
    upper = "A-ZÁÉÍÓÚÑ"
    return doc_text.select(
        "doc_id",
        extract(t, r"(?i)\bR\.?\s*U\.?\s*C\.?\s*[:\s]*\s*([0-9]{13})").alias("ruc"),
        extract_first(t, [r"(?i)\bFACTURA\b.*?(?:No\.?|N[°º])\s*" + number, r"(?i)No,\s*" + number, number]).alias("invoice_number"),
        strip(extract(t, rf"(?iu)AMBIENTE\s*:\s*([{upper} ]+)")).alias("environment"),
        extract_first(t, [stamp, r"(\d{2}/\d{2}/\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}/\d{2}/\d{2})"]).alias("issue_datetime"),
        strip(
            extract_first(
                t,
                [
                    rf"(?ium)Raz[oó]n\s+Social.*?[:\s]\s*([{upper}\s]+?)(?:\n|$)",
                    rf"(?ium)Razén\s+Social.*?[:\s]\s*([{upper}\s]+?)(?:\n|$)",
                    rf"(?ium)([{upper}\s]+?)\s*Raz[oó]n\s+Social",
                ],
            )
        ).alias("buyer_name"),
        extract(t, r"(?i)Identificaci[oó]n.*?[:\s]\s*([0-9A-Z\-]+)").alias("buyer_id"),
        strip(extract(t, r"(?i)(FARMACIA.*)")).alias("emitter_name"),
    )


def image_fields(doc_text: DataFrame) -> DataFrame:
    """Fields of an invoice image, patterns in order."""
    t = F.col("text")
    money = r"[:\s]*\$?(\d+[.,]\d{2})"
    day = r"[:\s]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
    total = extract_first(t, [rf"(?i)Total{money}", rf"(?i)Importe Total{money}", rf"(?i)Valor Total{money}"])
    return doc_text.select(
        "doc_id",
        extract_first(t, [r"(?i)RUC[:\s]*(\d{13})", r"(?i)R\.U\.C[:\s]*(\d{13})", r"(\d{13})"]).alias("ruc"),
        strip(extract_first(t, [rf"(?iu){w}[:\s]*([^\n]+)" for w in ("Razón Social", "Razon Social", "Empresa")])).alias("razonSocial"),
        extract_first(t, [rf"(?iu)Fecha{day}", rf"(?iu)Emisión{day}"]).alias("fechaEmision"),
        as_double(F.replace(total, F.lit(","), F.lit("."))).alias("importeTotal"),
        extract_first(t, [r"(?i)Clave de Acceso[:\s]*(\d{49})", r"(?i)Clave Acceso[:\s]*(\d{49})", r"(\d{49})"]).alias("claveAcceso"),
    )


# Label of each printed-form field.
FORM_LABELS = {
    "ambiente": "Ambiente",
    "tipo_emision": "Tipo de Emisión",
    "tipo_documento": "Tipo de Documento",
    "establecimiento": "Establecimiento",
    "punto_emision": "Punto de Emisión",
    "secuencial": "Secuencial",
    "numero_autorizacion": "Número de Autorización",
    "fecha_autorizacion": "Fecha de Autorización",
    "total": "Total",
    "moneda": "Moneda",
}
# Document kinds by keyword, tried in order.
FORM_KINDS = [
    ("factura", "FACTURA"),
    ("nota_credito", "NOTA DE CR[ÉE]DITO"),
    ("nota_debito", "NOTA DE D[ÉE]BITO"),
    ("retencion", "RETENCI[ÓO]N"),
    ("liquidacion", "LIQUIDACI[ÓO]N"),
    ("guia_remision", "GU[ÍI]A"),
]
# Marks of a printed form.
FORM_MARKS = [
    "RIDE", r"RUC:\s*\d{13}", "Razón Social:", "Fecha de Emisión:", "Número de Autorización:", "Clave de Acceso:",
    "Ambiente:", "Tipo de Emisión:",
]
# References to signed files.
REFERENCE_PATTERNS = [
    (r"(?iu)Clave de Acceso:\s*([A-Z0-9]{49})", 1),
    (r"(?iu)XML:\s*([^\n]+)", 1),
    (r"(?iu)Archivo XML:\s*([^\n]+)", 1),
    (r"(?iu)Firma Digital:\s*([^\n]+)", 1),
    (r"(?iu)Certificado:\s*([^\n]+)", 1),
    (r"https?://[^\s]+", 0),
    (r"file://[^\s]+", 0),
    (r"[A-Za-z]:\\[^\s]+", 0),
    (r"/[^\s]+\.xml", 0),
]


def form_fields(doc_text: DataFrame) -> DataFrame:
    """Fiscal metadata, kind and references of a printed electronic document."""
    t = F.col("text")
    is_form = F.upper(t).contains("RIDE")
    stated = strip(extract(t, r"(?iu)Tipo de Documento:\s*([^\n]+)"))
    kind = F.when(is_form, "ride")
    for source in (stated, t):
        for name, pattern in FORM_KINDS:
            kind = kind.when(F.coalesce(source.rlike("(?iu)" + pattern), F.lit(False)), name)
    n_refs = sum((F.regexp_count(t, F.lit(p)) for p, _ in REFERENCE_PATTERNS), F.lit(0))
    marks = sum((t.rlike("(?iu)" + p).cast("int") for p in FORM_MARKS), F.lit(0))
    return doc_text.select(
        "doc_id",
        kind.otherwise("documento_fiscal").alias("tipo"),
        *[strip(extract(t, rf"(?iu){label}:\s*([^\n]+)")).alias(name) for name, label in FORM_LABELS.items()],
        extract(t, r"Clave de Acceso:\s*([A-Z0-9]{49})").alias("clave_acceso"),
        F.when(is_form, extract(t, r"RUC:\s*(\d{13})")).alias("ruc_emisor"),
        F.when(is_form, strip(extract(t, r"Razón Social:\s*([^\n]+)"))).alias("razon_social"),
        n_refs.cast("bigint").alias("n_referencias"),
        marks.cast("bigint").alias("n_marcas"),
    )


def _reference(pattern_no: int, value: Column) -> Column:
    return F.struct(F.lit(pattern_no).alias("patron"), value.alias("valor"))


def form_references(doc_text: DataFrame) -> DataFrame:
    """Each reference to a signed file or address as a row."""
    t = F.col("text")
    rows = F.flatten(
        F.array(
            *[
                F.transform(extract_all(t, p, g), partial(_reference, i))
                for i, (p, g) in enumerate(REFERENCE_PATTERNS)
            ]
        )
    )
    return doc_text.select("doc_id", F.explode(rows).alias("_r")).select(
        "doc_id", F.when(F.col("_r.patron") < 5, "referencia_xml").otherwise("url_archivo").alias("tipo"), "_r.valor"
    )


def xml_fiscal_ids(sri_xml: DataFrame) -> DataFrame:
    """Identifiers anywhere in an XML: element texts, then attributes; the last hit wins."""
    x = F.col("xml")
    texts = F.transform(extract_all(x, r">([^<>]+)(?=<)", 1), strip)
    attrs = F.concat(extract_all(x, r"=\"([^\"]*)\"", 1), extract_all(x, r"='([^']*)'", 1))
    last = lambda values, pattern: F.try_element_at(F.filter(values, lambda v: v.rlike(pattern)), F.lit(-1))
    both = F.concat(texts, attrs)
    key = last(both, r"^[A-Z0-9]{49}$")
    return sri_xml.select(
        "clave",
        last(both, r"^\d{13}$").alias("ruc_emisor"),
        key.alias("clave_acceso"),
        last(texts, r"^\d{4}-\d{2}-\d{2}").alias("fecha_emision"),
        key.isNotNull().alias("es_documento_sri"),
    )


def sri_format_check(fields: DataFrame) -> DataFrame:
    """Verdict without asking anyone: key and taxpayer number present, key well formed."""
    key, ruc = F.coalesce("claveAcceso", F.lit("")), F.coalesce("ruc", F.lit(""))
    enough = (key != "") & (ruc != "")
    return fields.select(
        "doc_id",
        (enough & key_valid(key)).alias("formato_valido"),
        F.when(~enough, "datos_insuficientes").when(~key_valid(key), "clave_invalida").otherwise("ok").alias("motivo"),
    )


# ---------------------------------------------------------------- amounts

_M = r"[:\s]*\$?\s*([0-9]+[.,][0-9]{2})"
# Amount patterns in order, with the usual range of a value.
INVOICE_AMOUNTS = {
    "importeTotal": (0.1, 15000.0, [
        r"total\s*a\s*pagar" + _M, r"valor\s*total" + _M, r"importe\s*total" + _M, r"gran\s*total" + _M,
        r"\bTOTAL\b[^0-9]{0,15}\$?\s*([0-9]+[.,][0-9]{2})", r"total.*?([0-9]+[.,][0-9]{2})",
    ]),
    "subtotal": (0.1, 10000.0, [
        r"subtotal\s*(?:sin\s*)?(?:impuestos?)?" + _M, r"subtotal\s*(?:15%|0%)?" + _M, r"base\s*imponible" + _M,
        r"sin\s*impuestos" + _M, r"subtotal.*?([0-9]+[.,][0-9]{2})",
    ]),
    "iva": (0.0, 5000.0, [
        r"iva\s*(?:15%?|12%?)?" + _M, r"i\.?v\.?a\.?\s*(?:15%?)?" + _M, r"impuesto\s*(?:valor\s*agregado)?" + _M,
        "15%" + _M, "12%" + _M, r"iva.*?([0-9]+[.,][0-9]{2})",
    ]),
    "descuento": (0.0, 1000.0, [
        "descuento" + _M, r"total\s*descuento" + _M, "rebaja" + _M, r"descuento.*?([0-9]+[.,][0-9]{2})",
    ]),
}
_C = r"\s*[:\s]\s*\$?\s*([0-9.,]+)"
# Amount labels of a photographed invoice.
CAPTURE_AMOUNTS = {
    "subtotal15": [r"SUBTOTAL\s*15%" + _C],
    "subtotal0": [r"SUBTOTAL\s*0%" + _C],
    "subtotal_no_objeto": [r"SUBTOTAL\s+NO\s+OBJETO\s+DE\s+IVA" + _C],
    "subtotal_sin_impuestos": [r"SUBTOTAL\s+SIN\s+IMPUESTOS" + _C],
    "descuento": [r"(?:TOTAL\s+DESCUENTO|DESCUENTO)" + _C],
    "iva15": [r"IVA\s*15%?" + _C],
    "total": [
        r"(?:VALOR\s+TOTAL|TOTAL\s*FACTURA|TOTAL)" + _C, r"VALOR\s+TOTAL\s*:\s*\$?\s*([0-9.,]+)",
        r"(?m)\$?\s*([0-9]{1,3}(?:[.,]\d{2})?)\s*$",
    ],
}


def usual_ranges(amounts: dict) -> dict[str, tuple[float, float]]:
    """The ranges that come with a table of amount patterns, for callers that want them as limits."""
    return {name: (lo, hi) for name, (lo, hi, _) in amounts.items()}


def _in_range(limits: tuple[float, float] | None, value: Column) -> Column:
    return value if limits is None else F.when(value.between(*limits), value)


def invoice_amounts(doc_text: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Total, subtotal, VAT and discount: the first hit of the first pattern that has one.

    With `limits` (name to lowest and highest value) a hit outside them sends the search on to the next pattern. `fuera_de_rango` names
    the amounts found that lie outside their usual range, in the order of the columns.
    """
    df = doc_text.select("doc_id", strip_accents(F.col("text")).alias("_t"))
    cols = []
    for name, (_, _, patterns) in INVOICE_AMOUNTS.items():
        values = [to_float(extract(F.col("_t"), "(?i)" + p)) for p in patterns]
        cols.append(F.coalesce(*[let(v, partial(_in_range, (limits or {}).get(name))) for v in values]).alias(name))
    unusual = [F.when(~F.col(name).between(lo, hi), F.lit(name)) for name, (lo, hi) in usual_ranges(INVOICE_AMOUNTS).items()]
    return df.select("doc_id", *cols).withColumn("fuera_de_rango", F.array_compact(F.array(*unusual)))


def capture_amounts(doc_text: DataFrame) -> DataFrame:
    t = F.col("text")
    cols = []
    for name, patterns in CAPTURE_AMOUNTS.items():
        values = [normalize_decimal(extract(t, "(?i)" + p)) for p in patterns]
        cols.append(F.coalesce(*[truthy(v) for v in values[:-1]], values[-1]).alias(name))
    return doc_text.select("doc_id", *cols)


def form_amounts(doc_text: DataFrame) -> DataFrame:
    """Total and rates of a printed form."""
    t = F.col("text")
    total = extract(t, r"(?i)(?:VALOR\s+TOTAL|TOTAL)\D{0,30}([0-9]+[.,][0-9]{2})")
    plain = lambda p: as_double(F.replace(extract(t, p), F.lit(","), F.lit(".")))
    return doc_text.select(
        "doc_id",
        as_double(F.replace(total, F.lit(","), F.lit("."))).alias("total"),
        plain(r"(?i)SUBTOTAL\s+0%[:\s]*([0-9]+[.,][0-9]{2})").alias("subtotal_0"),
        plain(r"(?i)SUBTOTAL\s+15%[:\s]*([0-9]+[.,][0-9]{2})").alias("subtotal_15"),
        plain(r"(?i)IVA\s+15%[:\s]*([0-9]+[.,][0-9]{2})").alias("iva_15"),
    )


_E = r"\s*:?\s*\$?\s*([0-9]+[.,][0-9]{1,2})"
# Wide net of amount patterns, in order.
EXHAUSTIVE_AMOUNTS = {
    "subtotal": (0.1, 10000.0, [
        r"subtotal\s*(?:sin\s*)?(?:impuestos?)?" + _E, r"subtotal\s*(?:15%|0%)?" + _E, r"base\s*imponible" + _E,
        r"sin\s*impuestos" + _E, r"(?:^|\n)\s*([0-9]+[.,][0-9]{2})\s*(?=\n|$)", r"subtotal.*?([0-9]+[.,][0-9]{2})",
    ]),
    "iva": (0.0, 5000.0, [
        r"iva\s*(?:15%?|12%?)?" + _E, r"i\.?v\.?a\.?\s*(?:15%?)?" + _E, r"impuesto\s*(?:valor\s*agregado)?" + _E,
        "15%" + _E, "12%" + _E, r"iva.*?([0-9]+[.,][0-9]{2})",
    ]),
    "total": (0.1, 15000.0, [
        r"valor\s*total" + _E, r"total\s*a\s*pagar" + _E, r"importe\s*total" + _E, r"gran\s*total" + _E,
        r"valor\s*total\s*\|?\s*([0-9]+[.,][0-9]{2})", r"total\s*\|\s*([0-9]+[.,][0-9]{2})", r"total.*?([0-9]+[.,][0-9]{2})",
        r"(?:^|\n|\s)([2-9][0-9][.,][0-9]{2})(?:\s*\n|$|\s*$)", r"(?:^|\n|\s)([1-9][0-9]{2}[.,][0-9]{2})(?:\s*\n|$|\s*$)",
        r"(?:^|\n)\s*([0-9]{1,3}[.,][0-9]{2})\s*(?:\n|$)",
    ]),
}


def _candidate(name: str, pattern_no: int, value: Column, hit: Column) -> Column:
    return F.struct(F.lit(name).alias("concepto"), F.lit(pattern_no).alias("patron"), hit.alias("hit"), value.alias("valor"))


def _wide_net(text: Column, limits: dict[str, tuple[float, float]] | None) -> dict[str, Column]:
    """Arrays of the hits of the wide net by amount, or of those within the given limits."""
    found = {}
    for name, (_, _, patterns) in EXHAUSTIVE_AMOUNTS.items():
        groups = []
        for i, p in enumerate(patterns):
            values = F.transform(extract_all(text, "(?im)" + p, 1), lambda v: as_double(F.replace(v, F.lit(","), F.lit("."))))
            groups.append(F.transform(values, partial(_candidate, name, i)))
        lo, hi = (limits or {}).get(name, (None, None))
        found[name] = F.filter(F.flatten(F.array(*groups)), lambda c: c["valor"].isNotNull() if lo is None else c["valor"].between(lo, hi))
    return found


def amount_candidates(doc_text: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Every hit of the wide net, or those within the given limits: (doc_id, concepto, patron, hit, valor)."""
    found = F.concat(*_wide_net(F.col("text"), limits).values())
    return doc_text.select("doc_id", F.explode(found).alias("_c")).select("doc_id", "_c.*")


def exhaustive_amounts(doc_text: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Subtotal and VAT: first hit of the first matching pattern. Total: first pattern, largest value.

    Also the number of different total candidates and their spread. A text is settled inside its row, so nothing is gathered.
    """
    found = doc_text.select("doc_id", *[c.alias(f"_{n}") for n, c in _wide_net(F.coalesce("text", F.lit("")), limits).items()])

    def best(name: str) -> Column:
        place = lambda c: -c["valor"] if name == "total" else c["hit"].cast("double")
        ranked = F.transform(f"_{name}", lambda c: F.struct(c["patron"].alias("patron"), place(c).alias("place"), c["valor"].alias("valor")))
        return F.array_min(ranked)["valor"].alias(name)

    totals = F.transform("_total", lambda c: c["valor"])
    return found.select(
        "doc_id",
        *[best(n) for n in EXHAUSTIVE_AMOUNTS],
        F.size(F.array_distinct(totals)).cast("bigint").alias("n_totales"),
        (F.array_max(totals) - F.array_min(totals)).alias("totales_rango"),
    )


def infer_missing(subtotal: Column, iva: Column, total: Column) -> list[Column]:
    """Fill subtotal and VAT from the total: total - VAT, else total / 1.15; zero counts as missing."""
    s0, i0, t = F.coalesce(subtotal, F.lit(0.0)), F.coalesce(iva, F.lit(0.0)), F.coalesce(total, F.lit(0.0))
    by_rate = (t > 0) & (s0 == 0) & (i0 == 0)
    s1 = F.when((t > 0) & (s0 == 0) & (i0 > 0) & (t - i0 > 0), t - i0).when(by_rate, t / 1.15).otherwise(s0)
    i1 = F.when(by_rate, t - t / 1.15).otherwise(i0)
    i2 = F.when((s1 > 0) & (i1 == 0) & (t > s1), t - s1).otherwise(i1)
    return [s1.alias("subtotal"), i2.alias("iva"), t.alias("total")]


# ---------------------------------------------------------------- line items

_N = r"(\d+(?:[.,]\d+)?)"
# Fixed values.
_SKIP_LINE = r"(?i)(DESCRIPCION|CANTIDAD|PRE\.?U|UNI|PRE\.?TOT|TOTAL|SUBTOTAL|IVA|TARIFA)"
# Item line shapes in order, with the group of description, quantity, price and total.
ITEM_SHAPES = [
    (rf"^(.+?)\s+{_N}\s+{_N}\s+{_N}$", 1, 2, 3, 4),
    (rf"^(.+?)\s+{_N}\s+.*?{_N}\s+{_N}$", 1, 2, 3, 4),
    (rf"^\s*\d+\s+{_N}\s+(.+?)\s+{_N}\s+{_N}\s+{_N}$", 2, 1, 3, 5),
    (rf"^\s*(?:\d+\s+)?{_N}\s+(.{{10,}}?)\s+{_N}\s+\d+(?:[.,]\d+)?\s+{_N}$", 2, 1, 3, 4),
]


def _item(desc: Column, qty: Column, unit: Column, total: Column) -> Column:
    return F.struct(
        strip(desc).alias("descripcion"), qty.alias("cantidad"), unit.alias("precio_unitario"), total.alias("precio_total")
    )


def _explode_items(df: DataFrame, items: Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(items).alias("item_no", "_i")).select("doc_id", "item_no", "_i.*")


def items_from_text(doc_text: DataFrame) -> DataFrame:
    """Items of a normal invoice text: lines after the description header, four shapes in order."""
    plain = strip_accents(F.col("text"))
    body = F.regexp_replace(plain, r"(?is)^.*?(?=\bDESCRIPCION\b)", "")
    df = doc_text.select("doc_id", lines_of(body).alias("_l"))

    def parse(x: Column) -> Column:
        shaped = None
        for pattern, d, q, u, t in ITEM_SHAPES:
            g = lambda n, p=pattern: F.regexp_extract(x, p, n)
            item = _item(g(d), to_float(g(q)), to_float(g(u)), to_float(g(t)))
            shaped = F.when(x.rlike(pattern), item) if shaped is None else shaped.when(x.rlike(pattern), item)
        return F.when(~x.rlike(_SKIP_LINE), shaped)

    parsed = F.filter(F.transform("_l", parse), lambda i: (i["cantidad"] > 0) & (i["precio_unitario"] >= 0) & (i["precio_total"] >= 0))
    return _explode_items(df, parsed)


# Fixed values.
_TABLE_HEAD = r"(?i)(DESCRIPCION|DESCRIPTION|DETALLE|CONCEPTO|PRODUCTO)"
_TABLE_END = r"(?i)(SUBTOTAL|TOTAL|IVA|DESCUENTO|VALOR\s*TOTAL)"


def item_section(lines: Column) -> Column:
    """Lines between the table header and the first totals line after it; empty without a header.

    Lines are read once each: up to the header, then up to the totals line.
    """
    no_lines = F.array().cast("array<string>")

    def after(x: Column) -> Column:
        marks = F.transform(x, lambda v: v.rlike(_TABLE_END))
        return F.slice(x, 1, let(F.array_position(marks, F.lit(True)), lambda end: F.when(end > 0, end - 1).otherwise(F.size(x))).cast("int"))

    def section(x: Column) -> Column:
        head = F.array_position(F.transform(x, lambda v: v.rlike(_TABLE_HEAD)), F.lit(True))
        rest = let(head, lambda h: F.when(h > 0, F.slice(x, h.cast("int") + 1, F.greatest(F.size(x) - h.cast("int"), F.lit(0)))))
        return let(rest, lambda r: F.when(r.isNotNull(), after(r)).otherwise(no_lines))

    return let(lines, section)


def items_from_ocr(doc_text: DataFrame, most_unit: float | None = None, most_total: float | None = None) -> DataFrame:
    """Items of recognised text by trailing decimals; a 10% mismatch takes the third number from the end.

    `most_unit` and `most_total` leave lines of larger prices or totals out. What is read from a line is bound once.
    """
    df = doc_text.select("doc_id", item_section(lines_of(strip_accents(F.col("text")))).alias("_l"))

    def read(x: Column, i: Column) -> Column:
        dec = F.transform(extract_all(x, r"\b\d+[.,]\d{1,4}\b"), lambda v: as_double(F.replace(v, F.lit(","), F.lit("."))))
        return let(dec, lambda d: F.when(F.size(d) >= 2, priced(x, i, d)))

    def priced(x: Column, i: Column, dec: Column) -> Column:
        skip = (F.length(x) < 5) | x.rlike(r"^[-=\s]+$") | x.rlike(r"(?i)(CANTIDAD|PRECIO|TOTAL|UNIDAD)")
        whole = F.transform(extract_all(x, r"\b\d+\b"), lambda v: v.try_cast("double"))
        first = F.coalesce(F.get(F.filter(whole, lambda v: v.between(1, 100)), F.lit(0)), F.lit(1.0))
        at = lambda k: F.try_element_at(dec, F.lit(k))
        good = (at(-2) > 0) & (at(-1) > 0)
        if most_total is not None:
            good = good & (at(-1) <= most_total)

        def item(qty: Column) -> Column:
            off = F.abs(qty * at(-2) - at(-1)) > at(-1) * 0.1
            unit = F.when(off & (F.size(dec) >= 3), at(-3)).otherwise(at(-2))
            return let(unit, lambda u: F.when((u > 0) if most_unit is None else (u > 0) & (u <= most_unit), _item(named(x, i), qty, F.bround(u, 2), F.bround(at(-1), 2))))

        return F.when(~skip & good, let(first, item))

    def named(x: Column, i: Column) -> Column:
        head = F.regexp_extract(x, r"^(.*?)\s*\d", 1)
        desc = strip(F.regexp_replace(strip(head), r"[^\w\s]", " "))
        return let(desc, lambda d: F.when(F.length(d) < 3, F.concat(F.lit("Producto "), (i + 1).cast("string"))).otherwise(d))

    return _explode_items(df, F.filter(F.transform("_l", read), lambda i: i.isNotNull()))


# Words that no product description contains.
NOT_PRODUCTS = [
    "TOTAL", "SUBTOTAL", "IVA", "DESCUENTO", "FACTURA", "RUC", "AUTORIZACION", "CLAVE", "ACCESO", "NUMERO", "AMBIENTE",
    "FECHA", "EMISION", "DIRECCION", "EMAIL", "DOCUMENTO", "DEDUCIBLE", "NOMBRE",
]
_UP = "A-Za-zÁÉÍÓÚÑáéíóúñ"
# Fixed values.
_CODED = rf"^(\d{{2,}})\s+(\d+)\s+{_N}\s+(.+?)\s+{_N}\s+(?:{_N}\s+)?{_N}\s*$"
_LOOSE = [
    (rf"^([{_UP}\s]+?)\s+{_N}\s+{_N}\s*$", True),
    (rf"^([{_UP}\s]+?)\s+\$?{_N}\s*$", False),
    (rf"^([{_UP}\s]+?)\s+{_N}\s*$", False),
]


def items_from_capture(doc_text: DataFrame, most: float | None = None) -> DataFrame:
    """Coded table lines of a photographed invoice; without any, description and price lines, of prices up to `most` if given."""
    df = doc_text.select("doc_id", lines_of(F.col("text")).alias("_l"))
    num = normalize_decimal

    def coded(x: Column) -> Column:
        g = lambda n: F.regexp_extract(x, _CODED, n)
        return F.when(x.rlike(_CODED), _item(g(4), num(g(3)), num(g(5)), num(g(7))))

    def loose(pattern: str, two: bool):
        def parse(x: Column) -> Column:
            g = lambda n: F.regexp_extract(x, pattern, n)
            desc = strip(g(1))
            first = num(g(2))
            last = num(g(3)) if two else first
            bad = (F.length(desc) < 5) | contains_any(F.upper(desc), NOT_PRODUCTS) | desc.endswith(":") | desc.endswith(".")
            big = F.lit(False) if most is None else F.coalesce((first > most) | (last > most), F.lit(False))
            return F.when(x.rlike(pattern) & ~bad & ~big, _item(desc, F.lit(1.0), first, F.coalesce(truthy(last), first)))

        return parse

    keep = lambda a: F.filter(a, lambda i: i.isNotNull())
    table = keep(F.transform("_l", coded))
    fallback = F.concat(*[keep(F.transform("_l", loose(p, two))) for p, two in _LOOSE])
    return _explode_items(df, F.when(F.size(table) > 0, table).otherwise(fallback))


def items_from_image(doc_text: DataFrame) -> DataFrame:
    """Quantity, description and price on one line of an invoice image."""
    shape = r"(\d+)\s+([^$]+?)\s+\$?(\d+[.,]\d{2})"
    df = doc_text.select("doc_id", F.split("text", "\n").alias("_l"))

    def parse(x: Column) -> Column:
        g = lambda n: F.regexp_extract(x, shape, n)
        price = as_double(F.replace(g(3), F.lit(","), F.lit(".")))
        ok = x.rlike(r"\d+[.,]\d{2}") & (F.length(strip(x)) > 10) & x.rlike(shape)
        return F.when(ok, _item(g(2), as_double(g(1)), F.lit(None).cast("double"), price))

    return _explode_items(df, F.filter(F.transform("_l", parse), lambda i: i.isNotNull()))


# ---------------------------------------------------------------- semantic rules

_AMOUNT = r"(?:\$?\s*)?(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|\d+(?:[.,]\d{2})?)"


def semantic_rules(doc_text: DataFrame) -> DataFrame:
    """Dates, keyword amounts, coherence and identifiers of a text; unknown coherence stays null."""
    t = F.col("text")

    def keyword(words: Sequence[str]) -> Column:
        return F.coalesce(*[norm_amount(extract(t, rf"(?i){w}\s*[:\-]?\s*{_AMOUNT}")) for w in words])

    biggest = F.array_max(F.transform(extract_all(t, _AMOUNT, 1), norm_amount))
    df = doc_text.select(
        "doc_id",
        F.array_sort(
            F.array_distinct(
                F.concat(extract_all(t, r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"), extract_all(t, r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"))
            )
        ).alias("fechas"),
        keyword(["subtotal", "sub total"]).alias("subtotal"),
        keyword(["iva", "impuesto", "tax", "vat"]).alias("iva"),
        F.coalesce(keyword(["total", "valor total", "importe total"]), biggest).alias("total"),
    )
    gap = F.abs(F.col("subtotal") + F.coalesce("iva", F.lit(0.0)) - F.col("total"))
    return df.withColumn("amounts_consistent", gap < F.greatest(F.lit(0.02), F.col("total") * 0.01))


def extract_ids(doc_text: DataFrame) -> DataFrame:
    """Distinct 10- and 13-digit identifiers with the invalid ones among them."""
    t = F.col("text")
    ten = F.array_sort(F.array_distinct(extract_all(t, r"\b\d{10}\b")))
    thirteen = F.array_sort(F.array_distinct(extract_all(t, r"\b\d{13}\b")))
    return doc_text.select(
        "doc_id",
        ten.alias("cedulas"),
        thirteen.alias("rucs"),
        F.concat(F.filter(ten, lambda c: ~cedula_ok(c)), F.filter(thirteen, lambda r: ~ruc_ok(r))).alias("invalidos"),
    )


# Date and tool tags of an XMP packet.
XMP_TAGS = {
    "xmp_CreateDate": "xmp:CreateDate",
    "xmp_ModifyDate": "xmp:ModifyDate",
    "photoshop_DateCreated": "photoshop:DateCreated",
    "exif_DateTimeOriginal": "exif:DateTimeOriginal",
    "exif_DateTimeDigitized": "exif:DateTimeDigitized",
    "tiff_DateTime": "tiff:DateTime",
    "CreatorTool": "xmp:CreatorTool",
}


def xmp_fields(raw_docs: DataFrame) -> DataFrame:
    """Tags of the XMP packet as a map; attribute spellings of the same names are included."""
    t = F.decode("content", "ISO-8859-1")
    packet = F.regexp_extract(t, r"(?s)(<x:xmpmeta[^>]*>.*?</x:xmpmeta>)", 1)
    df = raw_docs.select("doc_id", packet.alias("_p"))
    entries = [
        F.struct(F.lit(k).alias("key"), F.coalesce(extract(F.col("_p"), f"<{tag}>([^<]+)</{tag}>"), extract(F.col("_p"), f'{tag}="([^"]+)"')).alias("value"))
        for k, tag in XMP_TAGS.items()
    ]
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.select("doc_id", (F.col("_p") != "").alias("xmp_present"), F.map_from_entries(F.transform(found, lambda e: F.struct(e["key"], strip(e["value"])))).alias("xmp"))
