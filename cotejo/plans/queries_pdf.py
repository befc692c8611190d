"""Registered queries on document bytes, signatures and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import layers, pdfbytes, signatures
from cotejo.plans.derived import BODIES_SQL, pdf_bodies, table
from cotejo.sources.documents import accept_docs, document_branch, file_kind, reject_docs

Q, SQL = {}, {}


def _n(p, g=""):
    return f"len(regexp_extract_all(body, '{p}'))"


def q_scan_documents(spark, d):
    """Documents up to a size limit, with their kind and branch."""
    docs = accept_docs(pdf_bodies(spark, d), 3000)
    return docs.select("doc_id", "size_bytes", file_kind(F.col("content")).alias("kind"), document_branch(F.col("content")).alias("branch"))


SQL["scan_documents"] = f"""WITH {BODIES_SQL} SELECT doc_id, octet_length(encode(body)) AS size_bytes, 'PDF' AS kind, 'pdf' AS branch
FROM bodies WHERE octet_length(encode(body)) <= 3000"""


def q_scan_rejects(spark, d):
    return reject_docs(pdf_bodies(spark, d), 3000).select("doc_id", "size_bytes", "reason")


SQL["scan_rejects"] = f"""WITH {BODIES_SQL} SELECT doc_id, octet_length(encode(body)) AS size_bytes, 'demasiado_grande' AS reason
FROM bodies WHERE octet_length(encode(body)) > 3000"""


def q_magic_bytes(spark, d):
    """Web pages and texts by leading bytes."""
    heads = F.array(*[F.lit(h) for h in ("", "25504446", "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "424D", "49492A00", "38425053", "0000001866747970")])
    p = table(spark, d, "pages")
    body = F.concat(F.to_binary(F.get(heads, (F.col("page_id") % 9).cast("int")), F.lit("hex")), F.when(F.col("page_id") % 9 == 8, F.encode(F.lit("heic"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")), F.encode("html", "UTF-8"))
    docs = p.select(F.col("page_id").alias("doc_id"), body.alias("content"))
    return docs.select("doc_id", file_kind(F.col("content")).alias("kind"), document_branch(F.col("content")).alias("branch"))


SQL["magic_bytes"] = """SELECT page_id AS doc_id,
  ['UNKNOWN', 'PDF', 'JPEG', 'PNG', 'GIF', 'BMP', 'TIFF', 'PSD', 'HEIC'][CAST(page_id % 9 + 1 AS INT)] AS kind,
  CASE WHEN page_id % 9 IN (0, 4, 5, 6, 7, 8) THEN 'xml' ELSE 'pdf' END AS branch FROM pages"""


def q_pdf_markers(spark, d):
    return pdfbytes.pdf_markers(pdf_bodies(spark, d))


SQL["pdf_markers"] = f"""WITH {BODIES_SQL} SELECT doc_id, contains(body, '/JavaScript') OR contains(body, '/JS') AS has_js,
  contains(body, '/EmbeddedFiles') OR contains(body, '/FileAttachment') AS has_embedded,
  contains(body, '/AcroForm') OR contains(body, '/Annots') AS has_forms FROM bodies"""


def q_pdf_counts(spark, d):
    return pdfbytes.pdf_counts(pdf_bodies(spark, d))


SQL["pdf_counts"] = f"""WITH {BODIES_SQL}, n AS (SELECT doc_id, {_n('startxref')} AS startxref, {_n('%%EOF')} AS eof, {_n('/XObject')} AS xobjects,
  contains(body, '/OCG') OR contains(body, '/OCProperties') AS has_ocg FROM bodies)
SELECT *, startxref > 1 OR eof > 1 AS incremental FROM n"""


def q_scanned_documents(spark, d):
    docs = pdf_bodies(spark, d).withColumn(
        "content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.encode(F.lit(" /Subtype /Image"), "UTF-8"))).otherwise(F.col("content"))
    )
    text = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pdf").alias("source"), F.when(F.col("page_id") % 2 == 0, "poco texto").otherwise(F.col("html")).alias("text"))
    return pdfbytes.is_scanned(docs, text)


SQL["scanned_documents"] = "SELECT page_id AS doc_id, page_id % 3 = 0 AND page_id % 2 = 0 AS escaneado FROM pages"


def q_size_check(spark, d):
    docs = pdf_bodies(spark, d).select(
        "doc_id", (F.col("size_bytes") * 10).alias("size_bytes"), (F.col("doc_id") % 4).cast("int").alias("pages"), (F.col("doc_id") % 2 == 0).alias("escaneado")
    )
    return pdfbytes.size_check(docs).select("doc_id", "ok", "bytes_por_pagina", "tipo")


SQL["size_check"] = f"""WITH {BODIES_SQL}, s AS (SELECT doc_id, octet_length(encode(body)) * 10 AS n, doc_id % 4 AS p, doc_id % 2 = 0 AS e FROM bodies)
SELECT doc_id, CASE WHEN p = 0 THEN true WHEN p = 1 THEN n >= 20000 AND n <= CASE WHEN e THEN 3500000 ELSE 1200000 END
  ELSE n / p >= 12000 AND n / p <= CASE WHEN e THEN 5250000 ELSE 1800000 END END AS ok,
  CASE WHEN p > 0 THEN n // p END AS bytes_por_pagina, CASE WHEN e THEN 'escaneado' ELSE 'textual' END AS tipo FROM s"""


def q_producer_ok(spark, d):
    s = table(spark, d, "supplier")
    makers = F.array(*[F.lit(x) for x in ("iText 7", "Word", "LibreOffice 7", "Paint", "ReportLab")])
    meta = s.select(F.col("s_suppkey").alias("doc_id"), F.get(makers, (F.col("s_suppkey") % 5).cast("int")).alias("producer"), F.when(F.col("s_suppkey") % 3 == 0, "Adobe").otherwise("x").alias("creator"), F.lit("").alias("author"))
    return pdfbytes.producer_ok(meta)


SQL["producer_ok"] = "SELECT s_suppkey AS doc_id, s_suppkey % 5 IN (0, 2, 4) OR s_suppkey % 3 = 0 AS productor_conocido FROM supplier"


def q_layer_tokens(spark, d):
    return pdfbytes.pdf_layer_tokens(pdf_bodies(spark, d))


_TOKENS = ", ".join(f"CASE WHEN contains(body, '{t}') THEN '{t}' END" for t in pdfbytes.LAYER_TOKENS)
SQL["layer_tokens"] = f"""WITH {BODIES_SQL}, t AS (SELECT doc_id, list_filter([{_TOKENS}], lambda x: x IS NOT NULL) AS k, {_n('stream')} AS streams, {_n('endstream')} AS endstreams FROM bodies)
SELECT doc_id, array_to_string(k, ',') AS tokens, len(k) AS n_tokens, streams, endstreams, len(k) > 2 OR streams > 5 AS sospechoso FROM t"""


def q_stream_commands(spark, d):
    """Drawing commands written into the bodies of the pages."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    body = F.concat(
        F.repeat(F.lit("1 0 0 rg 10 20 "), (k % 3).cast("int")), F.lit("BT (a) Tj ET "), (k % 50).cast("string"), F.lit(" 20.5 30 40 re f "),
        F.when(k % 4 == 0, F.lit("5 6 7 8 re 1 1 1 rg f x BT (b) Tj ET")).otherwise(F.lit("")),
    )
    s = p.select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("stream_no"), F.encode(body, "UTF-8").alias("body"))
    return pdfbytes.stream_commands(s).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


SQL["stream_commands"] = """WITH k AS (SELECT page_id AS d, page_id % 3 AS r, page_id % 4 = 0 AS c FROM pages)
SELECT d AS doc_id, 'texto' AS kind, 1 + CAST(c AS INT) AS n FROM k UNION ALL SELECT d, 'rectangulo', 1 FROM k
UNION ALL SELECT d, 'color', r + CAST(c AS INT) FROM k WHERE r + CAST(c AS INT) > 0 UNION ALL SELECT d, 'tapado', 1 FROM k WHERE c"""


def q_signature_patterns(spark, d):
    s = pdfbytes.signature_patterns(pdf_bodies(spark, d))
    return s.select("doc_id", "n_byterange", "n_sig", "n_contents", "n_subfilter", "n_reason", "n_name", "firma_detectada", "tipo_firma", "confianza", "subfilter", "name")


SQL["signature_patterns"] = rf"""WITH {BODIES_SQL}, n AS (SELECT doc_id, {_n(r'/ByteRange\s*\[')} AS n_byterange, {_n(r'/Sig\b')} AS n_sig, {_n(r'/DigitalSignature\b')} AS dg,
  {_n(r'/Contents\s*<[0-9A-Fa-f\s]+>')} AS n_contents, {_n(r'/SubFilter\s*/')} AS n_subfilter, {_n(r'/Location\s*\(')} AS lo, {_n(r'/Reason\s*\(')} AS n_reason, {_n(r'/Name\s*\(')} AS n_name,
  nullif(regexp_extract(body, '/SubFilter\s*/([A-Za-z0-9.\-]+)', 1), '') AS subfilter, nullif(regexp_extract(body, '/Name\s*\(([^)]+)\)', 1), '') AS name FROM bodies)
SELECT doc_id, n_byterange, n_sig, n_contents, n_subfilter, n_reason, n_name, subfilter, name, n_byterange + n_sig + dg + n_contents > 0 AS firma_detectada,
  CASE WHEN n_byterange = 0 THEN 'ninguna' WHEN subfilter = 'adbe.pkcs7.detached' THEN 'adobe_pkcs7' ELSE 'otra' END AS tipo_firma,
  round(least(1.0::DOUBLE, CASE WHEN n_byterange > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN n_sig > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN dg > 0 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN n_contents > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n_subfilter > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN lo > 0 THEN 0.05::DOUBLE ELSE 0 END
    + CASE WHEN n_reason > 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN n_name > 0 THEN 0.05::DOUBLE ELSE 0 END), 4) AS confianza FROM n"""


def q_signature_bytes(spark, d):
    return pdfbytes.signature_bytes(pdf_bodies(spark, d))


_LITS = ", ".join(f"CASE WHEN contains(body, '{t}') THEN '{t}' END" for t in pdfbytes.SIGNATURE_LITERALS)
SQL["signature_bytes"] = f"""WITH {BODIES_SQL}, t AS (SELECT doc_id, list_filter([{_LITS}], lambda x: x IS NOT NULL) AS k, greatest({_n('/Sig')}, {_n('/ByteRange')}) AS n FROM bodies)
SELECT doc_id, len(k) > 0 AS firma_detectada, n AS cantidad_firmas, array_to_string(k, ',') AS patrones FROM t"""


def q_signature_integrity(spark, d):
    return pdfbytes.signature_integrity(pdf_bodies(spark, d))


SQL["signature_integrity"] = rf"""WITH {BODIES_SQL}, t AS (SELECT doc_id, {_n('xref')} AS xref,
  CASE WHEN TRY_CAST(regexp_extract(body, '/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\]', 3) AS BIGINT) - 100 > 100000 THEN 1 ELSE 0 END AS huecos FROM bodies)
SELECT doc_id, xref, huecos, xref <= 1 AND huecos = 0 AS documento_integro FROM t"""


def q_find_signatures(spark, d):
    return pdfbytes.find_signatures(pdf_bodies(spark, d)).select("doc_id", "sig_no", "br0", "br1", "br2", "br3", "subfilter", "reason", "name", "modificada")


SQL["find_signatures"] = f"""WITH {BODIES_SQL} SELECT doc_id, 0 AS sig_no, 0 AS br0, 100 AS br1, doc_id * 1000 + 200 AS br2, 50 AS br3,
  'adbe.pkcs7.detached' AS subfilter, 'Firma' AS reason, 'Ana' AS name, doc_id * 1000 + 250 <> octet_length(encode(body)) AS modificada FROM bodies WHERE doc_id % 4 = 0"""


def _sigs(spark, d):
    """Each event as a signature of its user's document."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), k.alias("sig_no"), F.lit(0).alias("br0"), F.lit(100).alias("br1"), (F.col("user_id") * 10 + k % 2).alias("br2"), F.lit(50).alias("br3"),
        F.when(k % 3 == 0, "ETSI.CAdES.detached").otherwise("adbe.pkcs7.detached").alias("subfilter"), (k % 5 > 0).alias("digest_match"), F.when(k % 7 > 0, k % 7 > 2).alias("crypto_ok"), (k % 4 == 1).alias("chain_ok"),
    )


def q_signature_summary(spark, d):
    s = _sigs(spark, d)
    sizes = s.select("doc_id", (F.col("doc_id") * 10 + 50).alias("size_bytes")).distinct()
    return pdfbytes.signature_summary(s, sizes)


SQL["signature_summary"] = """SELECT user_id AS doc_id, count(*) AS total_firmas, count(*) FILTER (event_id % 5 > 0) AS integridad_ok, count(*) FILTER (event_id % 2 = 0) AS sin_modificaciones,
  count(*) FILTER (event_id % 7 > 2) AS crypto_ok, count(*) FILTER (event_id % 4 = 1) AS chain_ok, count(*) FILTER (event_id % 3 = 0) AS pades,
  count(*) FILTER (event_id % 5 > 0 AND event_id % 2 = 0) AS firmas_validas FROM events GROUP BY 1"""


def q_signature_security(spark, d):
    """Security level per user from the signature summary."""
    s = q_signature_summary(spark, d)
    facts = s.select("doc_id", "firmas_validas", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.col("total_firmas") - F.col("firmas_validas")).alias("firmas_invalidas"), F.col("total_firmas").alias("cantidad_firmas"), (F.col("doc_id") % 3 == 0).alias("documento_integro"), (F.col("doc_id") % 5 == 0).alias("raiz_valida"))
    return pdfbytes.signature_security(facts)


SQL["signature_security"] = f"""WITH s AS ({SQL['signature_summary']}), f AS (SELECT doc_id, firmas_validas > 0 AS v, doc_id % 2 = 1 AND total_firmas > firmas_validas AS i, total_firmas > 3 AS m, doc_id % 3 = 0 AS ok, doc_id % 5 = 0 AS r FROM s),
w AS (SELECT *, list_filter([CASE WHEN v AND NOT ok THEN 'modificado_tras_firma' END, CASE WHEN NOT r THEN 'autoridad_no_confiable' END, CASE WHEN m THEN 'demasiadas_firmas' END, CASE WHEN i THEN 'firmas_invalidas' END], lambda x: x IS NOT NULL) AS k FROM f)
SELECT doc_id, CASE WHEN i THEN 'bajo' WHEN v AND ok THEN 'alto' WHEN v THEN 'medio' ELSE 'bajo' END AS nivel_seguridad, array_to_string(k, ',') AS vulnerabilidades, len(k) AS n_vulnerabilidades FROM w"""


def q_signature_verdict(spark, d):
    """Verdict for users' documents: even ones as PDF, odd ones as XML."""
    s = q_signature_summary(spark, d)
    pdf = s.where("doc_id % 2 = 0").select(
        "doc_id", F.lit(True).alias("basica"), F.lit(False).alias("por_patrones"), F.lit(0.5).alias("confianza"), F.lit("adobe_pkcs7").alias("tipo_patron"),
        F.when(F.col("doc_id") % 4 == 0, F.col("firmas_validas") > 25).alias("verificada"), F.col("total_firmas").alias("total"), F.col("firmas_validas").alias("validas"),
        F.col("crypto_ok").alias("crypto"), F.col("chain_ok").alias("chain"), "pades", (F.col("doc_id") % 3 == 0).alias("es_ride"), F.lit(None).cast("boolean").alias("autorizado"),
    )
    xml = s.where("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("total_firmas")).alias("total"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("total_firmas")).alias("validas"), (F.col("doc_id") % 5 == 0).alias("es_documento_sri"), F.lit(True).alias("autorizado"))
    return signatures.signature_verdict(pdf, xml)


SQL["signature_verdict"] = f"""WITH s AS ({SQL['signature_summary']})
SELECT doc_id, 'pdf' AS documento, CASE WHEN doc_id % 4 = 0 THEN firmas_validas > 25 ELSE true END AS firma_detectada, 'adobe_pkcs7' AS tipo_firma, total_firmas, firmas_validas,
  pades > 0 AS es_pades, doc_id % 3 = 0 AS es_documento_sri, CAST(NULL AS BOOLEAN) AS autorizado,
  CASE WHEN total_firmas > 1 THEN 'multiple' WHEN crypto_ok > 0 AND chain_ok > 0 THEN 'cualificada' WHEN crypto_ok > 0 THEN 'avanzada' ELSE 'basica' END AS tipo,
  CASE WHEN firmas_validas = total_firmas AND crypto_ok = total_firmas AND chain_ok = total_firmas THEN 'cualificado' WHEN firmas_validas = total_firmas AND crypto_ok = total_firmas THEN 'avanzado'
       WHEN firmas_validas = total_firmas THEN 'basico' ELSE 'parcial' END AS nivel FROM s WHERE doc_id % 2 = 0
UNION ALL
SELECT doc_id, 'xml', doc_id % 3 > 0, CASE WHEN doc_id % 3 > 0 THEN 'xades' ELSE 'ninguna' END, CASE WHEN doc_id % 3 > 0 THEN total_firmas ELSE 0 END, CASE WHEN doc_id % 3 > 0 THEN total_firmas ELSE 0 END,
  false, doc_id % 5 = 0, CASE WHEN doc_id % 5 = 0 THEN true END, CASE WHEN doc_id % 3 = 0 THEN 'ninguno' WHEN total_firmas > 1 THEN 'multiple' ELSE 'basica' END,
  CASE WHEN doc_id % 3 = 0 THEN 'ninguno' ELSE 'basico' END FROM s WHERE doc_id % 2 = 1"""


def q_pdf_suspicion(spark, d):
    c = q_pdf_counts(spark, d)
    facts = c.withColumn("has_meta", F.col("doc_id") % 2 == 0).withColumn("error", F.lit(False)).withColumn("has_text", F.col("doc_id") % 3 > 0).withColumn("amounts_consistent", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5 > 1))
    return pdfbytes.pdf_suspicion(facts)


SQL["pdf_suspicion"] = f"""WITH n AS ({SQL['pdf_counts']}), s AS (SELECT doc_id, least(100, CASE WHEN incremental THEN 25 ELSE 0 END + CASE WHEN startxref > 1 THEN 20 ELSE 0 END + CASE WHEN eof > 1 THEN 15 ELSE 0 END
  + CASE WHEN has_ocg THEN 15 ELSE 0 END + CASE WHEN xobjects > 20 THEN 10 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 8 END + CASE WHEN doc_id % 3 > 0 THEN 0 ELSE 10 END + CASE WHEN doc_id % 5 = 1 THEN 15 ELSE 0 END) AS sospecha FROM n)
SELECT doc_id, sospecha, CASE WHEN sospecha < 25 THEN 'baja' WHEN sospecha < 50 THEN 'media' WHEN sospecha < 75 THEN 'alta' ELSE 'muy_alta' END AS etiqueta FROM s"""


def q_ocg_signals(spark, d):
    s = layers.ocg_signals(pdf_bodies(spark, d))
    return s.select("doc_id", "ocg_count", "has_ocg", F.round("densidad", 4).alias("densidad"), F.round("confianza", 6).alias("confianza"))


def _sum_sql(patterns):
    return " + ".join(_n(p) for p in patterns)


SQL["ocg_signals"] = f"""WITH {BODIES_SQL}, n AS (SELECT doc_id, {_sum_sql(layers.OCG_PATTERNS)} AS c, greatest(1.0::DOUBLE, octet_length(encode(body)) / 1e6::DOUBLE) AS mb FROM bodies)
SELECT doc_id, c AS ocg_count, c > 0 AS has_ocg, round(c / mb, 4) AS densidad,
  round(least(0.95::DOUBLE, CASE WHEN c = 0 THEN 0 ELSE 0.05::DOUBLE END + 0.85::DOUBLE / (1 + exp(-8.0::DOUBLE * (least(c, 12) / 12.0::DOUBLE * 0.7::DOUBLE + least(1.0::DOUBLE, c / mb / 20) * 0.1::DOUBLE - 0.35::DOUBLE)))), 6) AS confianza FROM n"""


def q_overlay_signals(spark, d):
    s = layers.overlay_signals(pdf_bodies(spark, d))
    return s.select("doc_id", "overlay_count", "operadores", "streams", "transparencias", F.round("alpha_bajo", 4).alias("alpha_bajo"), F.round("bm_ratio", 4).alias("bm_ratio"), "modos", "alpha_min", "alpha_max", "streams_integros", "nivel_streams")


_OVERLAY = rf"""o AS (SELECT doc_id, {_sum_sql(layers.OVERLAY_PATTERNS)} AS overlay_count, {_sum_sql(layers.OPERATOR_PATTERNS)} AS operadores,
  greatest(1, len(regexp_extract_all(body, '(?s)stream\s*[\r\n]+(.*?)\s*endstream'))) AS streams,
  list_concat(list_transform(regexp_extract_all(body, '/CA\s+([\d.]+)', 1), lambda x: CAST(x AS DOUBLE)), list_transform(regexp_extract_all(body, '/ca\s+([\d.]+)', 1), lambda x: CAST(x AS DOUBLE))) AS a,
  regexp_extract_all(body, '/BM\s*/(\w+)', 1) AS m, {_n('stream' + chr(92) + 's')} AS st, {_n('endstream')} AS es FROM bodies
), w AS (SELECT *, len(list_filter(a, lambda x: x < 1)) AS low, len(list_filter(m, lambda x: lower(x) <> 'normal')) AS odd FROM o)"""
SQL["overlay_signals"] = f"""WITH {BODIES_SQL}, {_OVERLAY}
SELECT doc_id, overlay_count, operadores, streams, low AS transparencias, round(CASE WHEN len(a) > 0 THEN low / len(a) ELSE 0 END, 4) AS alpha_bajo, round(CASE WHEN len(m) > 0 THEN odd / len(m) ELSE 0 END, 4) AS bm_ratio,
  array_to_string(m, ',') AS modos, coalesce(list_min(a), 0) AS alpha_min, coalesce(list_max(a), 0) AS alpha_max, st = es AS streams_integros,
  CASE WHEN st > 20 OR operadores > 50 THEN 'high' WHEN st > 10 OR operadores > 20 THEN 'medium' ELSE 'low' END AS nivel_streams FROM w"""


def q_overlay_probability(spark, d):
    return layers.overlay_probability(layers.overlay_signals(pdf_bodies(spark, d)))


SQL["overlay_probability"] = f"""WITH {BODIES_SQL}, {_OVERLAY}, f AS (SELECT doc_id, overlay_count AS oc, low, least(1.0::DOUBLE, overlay_count / 20.0::DOUBLE) AS ov, CASE WHEN low > 0 THEN 1.0::DOUBLE ELSE 0 END AS al,
  CASE WHEN len(a) > 0 THEN low / len(a) ELSE 0 END AS ad, CASE WHEN len(m) > 0 THEN odd / len(m) ELSE 0 END AS bm, least(1.0::DOUBLE, operadores / 50.0::DOUBLE) AS op, least(1.0::DOUBLE, streams / 12.0::DOUBLE) AS st FROM w
), p AS (SELECT *, 1 / (1 + exp(-(-2.0::DOUBLE + ov * 2.0::DOUBLE + al * 1.3::DOUBLE + ad * 0.8::DOUBLE + bm * 0.9::DOUBLE + op * 0.7::DOUBLE + st * 0.3::DOUBLE))) AS p FROM f)
SELECT doc_id, oc > 3 OR low > 0 OR bm >= 0.2 AS has_overlays, CASE WHEN oc > 3 THEN ov ELSE 0 END AS overlay_score, round(p, 4) AS probabilidad, CASE WHEN p >= 0.75 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS nivel,
  round(greatest(0.35::DOUBLE, least(0.95::DOUBLE, 0.40::DOUBLE + (al + CASE WHEN bm > 0 THEN 1 ELSE 0 END + CASE WHEN ov > 0.4 THEN 1 ELSE 0 END) * 0.18::DOUBLE + (ad * 0.5::DOUBLE + least(1.0::DOUBLE, ov * 1.5::DOUBLE) * 0.5::DOUBLE) * 0.25::DOUBLE)), 3) AS confianza FROM p"""


def _diffs(spark, d):
    """Each event as a rendered layer of its user's document."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "stream").when(F.col("event_type") == "error", "annot").otherwise("ocg")
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("page"), kind.alias("kind"), F.col("event_id").cast("int").alias("k"), (F.col("value") / 1000).alias("diff_ratio"))


def q_layer_changes(spark, d):
    c = layers.layer_changes(_diffs(spark, d))
    return c.withColumn("proporcion", F.round("proporcion", 6))


_DIFFS = "df AS (SELECT user_id AS doc_id, event_id % 4 AS page, CASE WHEN event_type IN ('click', 'view') THEN 'stream' WHEN event_type = 'error' THEN 'annot' ELSE 'ocg' END AS kind, event_id AS k, value / 1000 AS r FROM events)"
SQL["layer_changes"] = f"""WITH {_DIFFS} SELECT doc_id, """ + ", ".join(f"count(*) FILTER (kind = '{k}') AS total_{k}, count(*) FILTER (kind = '{k}' AND r > 0.05) AS cambios_{k}" for k in ("stream", "annot", "ocg")) + ", round(avg(CASE WHEN r > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS proporcion FROM df GROUP BY 1"


def q_first_changing_stream(spark, d):
    return layers.first_changing_stream(_diffs(spark, d))


SQL["first_changing_stream"] = f"WITH {_DIFFS} SELECT doc_id, page, min(k) FILTER (r > 0.05) AS primer_stream, count(*) AS streams FROM df WHERE kind = 'stream' GROUP BY 1, 2"


def _meta(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return u.select("doc_id", F.lit("D:2024").alias("creation_date"), F.when(F.col("doc_id") % 2 == 0, "D:2024").otherwise("D:2025").alias("mod_date"), F.when(F.col("doc_id") % 3 == 0, "iText").otherwise("Otro").alias("producer"), (F.col("doc_id") % 4).alias("n_streams"))


def q_overlay_summary(spark, d):
    diffs, meta = _diffs(spark, d), _meta(spark, d)
    factor = layers.context_factor(meta.drop("n_streams"), meta.select("doc_id", "n_streams"))
    stream = layers.stream_probability(layers.first_changing_stream(diffs), factor)
    layer = layers.layer_probability(layers.layer_changes(diffs), factor)
    visual = layers.visual_probability(meta.select("doc_id", (F.col("doc_id") % 2).alias("anotaciones"), (F.col("doc_id") % 3).alias("sospechosos"), (F.col("doc_id") % 5).alias("paginas_diff")))
    patches = meta.select("doc_id", F.lit(0.0).alias("probabilidad"), F.lit("LOW").alias("nivel"))
    return layers.overlay_summary(visual, stream, layer, patches)


def _lv(p, h, m):
    return f"CASE WHEN {p} >= {h} THEN 'HIGH' WHEN {p} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"


SQL["overlay_summary"] = f"""WITH {_DIFFS}, f AS (SELECT DISTINCT doc_id, greatest(CASE WHEN doc_id % 2 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN doc_id % 3 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN doc_id % 4 <= 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 0.1::DOUBLE) AS factor FROM df),
s AS (SELECT doc_id, count(p) / count(*) AS p FROM (SELECT doc_id, page, min(k) FILTER (r > 0.05) AS p FROM df WHERE kind = 'stream' GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT doc_id, avg(CASE WHEN r > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM df GROUP BY 1),
v AS (SELECT doc_id, round(CASE WHEN doc_id % 2 > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN doc_id % 5 > 0 THEN 0.3::DOUBLE ELSE 0 END, 3) AS p FROM f),
r AS (SELECT doc_id, 'visual' AS a, p, {_lv('p', 0.7, 0.4)} AS n, p > 0.5 AS z FROM v
  UNION ALL SELECT s.doc_id, 'stream', round(p * factor, 3), {_lv('p * factor', 0.6, 0.3)}, round(p * factor, 3) > 0 FROM s JOIN f USING (doc_id)
  UNION ALL SELECT l.doc_id, 'capas', round(p * factor, 3), {_lv('p * factor', 0.6, 0.3)}, round(p * factor, 3) > 0 FROM l JOIN f USING (doc_id)
  UNION ALL SELECT doc_id, 'imagenes', 0, 'LOW', false FROM f)
SELECT doc_id, max(p) AS probabilidad, CASE WHEN count(*) FILTER (n = 'HIGH') > 0 OR max(p) >= 0.6 THEN 'HIGH' WHEN max(p) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS nivel_riesgo, count(*) FILTER (z) AS zonas,
  CASE WHEN count(*) FILTER (n = 'HIGH' AND a <> 'stream') > 0 THEN 'HIGH' WHEN count(*) FILTER (n = 'MEDIUM' AND a <> 'stream') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS nivel_capas FROM r GROUP BY 1"""


def q_layer_risk(spark, d):
    """Layer risk of the pages with text and structure signals given by their key."""
    docs = pdf_bodies(spark, d)
    sig = layers.overlay_signals(docs)
    prob = layers.overlay_probability(sig).join(sig.select("doc_id", "overlay_count"), "doc_id")
    text = docs.select("doc_id", ((F.col("doc_id") % 10) / 10).alias("probabilidad"))
    structure = docs.select("doc_id", (F.col("doc_id") % 2 == 0).alias("sospechosa"), ((F.col("doc_id") % 4) / 4).alias("puntaje"))
    return layers.layer_risk(layers.ocg_signals(docs), prob, text, structure)


SQL["layer_risk"] = f"""WITH {BODIES_SQL}, {_OVERLAY},
n AS (SELECT doc_id, {_sum_sql(layers.OCG_PATTERNS)} AS c, greatest(1.0::DOUBLE, octet_length(encode(body)) / 1e6::DOUBLE) AS mb FROM bodies),
g AS (SELECT n.doc_id, c, w.overlay_count AS oc, CASE WHEN len(m) > 0 THEN odd / len(m) ELSE 0 END AS bm, low,
  least(0.95::DOUBLE, CASE WHEN c = 0 THEN 0 ELSE 0.05::DOUBLE END + 0.85::DOUBLE / (1 + exp(-8.0::DOUBLE * (least(c, 12) / 12.0::DOUBLE * 0.7::DOUBLE + least(1.0::DOUBLE, c / mb / 20) * 0.1::DOUBLE - 0.35::DOUBLE)))) AS conf FROM n JOIN w USING (doc_id)),
s AS (SELECT doc_id, c, oc, CASE WHEN c > 0 THEN conf * 0.35::DOUBLE ELSE 0 END + CASE WHEN oc > 3 THEN least(1.0::DOUBLE, oc / 20.0::DOUBLE) * 0.25::DOUBLE ELSE 0 END
  + doc_id % 10 / 10 * 0.25::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 / 4 * 0.15::DOUBLE ELSE 0 END AS s FROM g),
l AS (SELECT *, CASE WHEN s >= 0.8 THEN 'VERY_HIGH' WHEN s >= 0.6 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' WHEN s >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS nivel FROM s)
SELECT doc_id, round_even(s, 3) AS puntaje, round_even(s * 100, 1) AS porcentaje, nivel, greatest(round_even(s * 15, 0), CASE nivel WHEN 'VERY_HIGH' THEN 15 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 9 WHEN 'LOW' THEN 6 ELSE 3 END)::INT AS penalizacion,
  round_even(least(1.0::DOUBLE, s + 0.1::DOUBLE), 3) AS confianza, CASE WHEN c > 0 THEN least(c // 2, 10) WHEN oc > 10 THEN least(oc // 5, 8) ELSE 0 END AS capas_estimadas, nivel <> 'VERY_LOW' AS has_layers FROM l"""


def q_certificate_info(spark, d):
    docs = pdf_bodies(spark, d)
    cert = F.concat(F.lit("CN=Ana "), F.col("doc_id").cast("string"), F.lit(",O="), F.when(F.col("doc_id") % 2 == 0, "Security Data").otherwise("Otra"), F.lit(",C=EC,"))
    docs = docs.withColumn("content", F.concat(F.encode(F.concat(F.lit("%PDF-1.4 "), cert), "UTF-8"), F.col("content")))
    return pdfbytes.certificate_info(docs).select("doc_id", "emisor", "organizacion", "raiz_valida", "pdf_version", "pkcs7_detached")


SQL["certificate_info"] = "SELECT page_id AS doc_id, 'Ana ' || CAST(page_id AS VARCHAR) AS emisor, CASE WHEN page_id % 2 = 0 THEN 'Security Data' ELSE 'Otra' END AS organizacion, page_id % 2 = 0 AS raiz_valida, '1.4' AS pdf_version, page_id % 4 = 0 AS pkcs7_detached FROM pages"


def _signed_xml(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    cert = F.when(k % 2 == 0, "<ds:KeyInfo><ds:X509Data><ds:X509Certificate>AA==</ds:X509Certificate></ds:X509Data></ds:KeyInfo>").otherwise("")
    stamp = F.when(k % 3 == 0, "<xades:EncapsulatedTimeStamp>AA==</xades:EncapsulatedTimeStamp>").otherwise("")
    policy = F.when(k % 5 == 0, "<xades:SignaturePolicyIdentifier/>").otherwise("")
    info = F.when(k % 7 > 0, '<ds:SignedInfo><ds:SignatureMethod Algorithm="rsa-sha1"/><ds:Reference URI=""/></ds:SignedInfo>').otherwise("")
    sig = F.concat(F.lit('<ds:Signature xmlns:ds="http://www.w3.org/2000/09/xmldsig#">'), info, cert, F.lit("<ds:Object>"), stamp, policy, F.lit("</ds:Object></ds:Signature>"))
    body = F.concat(F.lit("<factura><infoTributaria><ruc>"), F.lpad(k.cast("string"), 13, "1"), F.lit("</ruc></infoTributaria>"), F.repeat(sig, (k % 4).cast("int")), F.lit("</factura>"))
    return o.select(k.cast("string").alias("clave"), body.alias("xml"))


def q_xades_summary(spark, d):
    s = signatures.xades_summary(_signed_xml(spark, d))
    return s.select(F.col("clave").cast("bigint").alias("doc_id"), *[c for c in s.columns if c not in ("clave",)])


SQL["xades_summary"] = """WITH k AS (SELECT o_orderkey AS d, o_orderkey % 4 AS n, o_orderkey % 7 > 0 AS v FROM orders)
SELECT d AS doc_id, n AS total_firmas, CASE WHEN v THEN n ELSE 0 END AS firmas_validas, CASE WHEN v THEN 0 ELSE n END AS firmas_invalidas, CASE WHEN d % 2 = 0 THEN n ELSE 0 END AS con_certificados,
  CASE WHEN d % 3 = 0 THEN n ELSE 0 END AS con_timestamps, CASE WHEN d % 5 = 0 THEN n ELSE 0 END AS con_politicas, CASE WHEN n > 0 AND v THEN 100.0 ELSE 0.0 END AS porcentaje_validas FROM k"""

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
