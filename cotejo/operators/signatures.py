"""XML signatures and the signature verdict of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.text import extract

# The namespaces in which a signature element counts.
SIGNATURE_NAMESPACES = [
    "http://www.w3.org/2000/09/xmldsig#",
    "http://uri.etsi.org/01903/v1.3.2#",
    "http://uri.etsi.org/01903/v1.4.1#",
    "http://uri.etsi.org/01903/v1.1.1#",
]


def _has(block: Column, tag: str) -> Column:
    return block.rlike(rf"<(?:\w+:)?{tag}[\s>/]")


def _attr(block: Column, tag: str, attr: str) -> Column:
    return extract(block, rf"<(?:\w+:)?{tag}\s[^>]*?{attr}=[\"']([^\"']*)[\"']")


def _text(block: Column, tag: str) -> Column:
    return extract(block, rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)<")


def xades_signatures(sri_xml: DataFrame) -> DataFrame:
    """One row per signature element: structure, methods, certificates, timestamps and policy."""
    whole = r"(?s)(<(?:\w+:)?Signature[\s>].*?</(?:\w+:)?Signature>)"
    df = sri_xml.select("clave", F.posexplode(F.regexp_extract_all("xml", F.lit(whole), F.lit(1))).alias("sig_no", "_s"), F.col("xml").alias("_x"))
    s = F.col("_s")
    known = F.lit(False)
    for ns in SIGNATURE_NAMESPACES:
        known = known | F.col("_x").contains(ns)
    certs = F.regexp_count(s, F.lit(r"<(?:\w+:)?X509Certificate[\s>/]")).cast("bigint")
    return df.where(known).select(
        "clave",
        "sig_no",
        _has(s, "SignedInfo").alias("tiene_signed_info"),
        certs.alias("certificados"),
        F.regexp_count(s, F.lit(r"<(?:\w+:)?EncapsulatedTimeStamp[\s>/]")).cast("bigint").alias("timestamps"),
        F.regexp_count(s, F.lit(r"<(?:\w+:)?SignaturePolicyIdentifier[\s>/]")).cast("bigint").alias("politicas"),
        F.regexp_count(s, F.lit(r"<(?:\w+:)?Reference[\s>/]")).cast("bigint").alias("referencias"),
        _attr(s, "CanonicalizationMethod", "Algorithm").alias("canonicalizacion"),
        _attr(s, "SignatureMethod", "Algorithm").alias("metodo_firma"),
        _attr(s, "DigestMethod", "Algorithm").alias("metodo_resumen"),
        _text(s, "SigningTime").alias("momento_firma"),
        _text(s, "X509IssuerName").alias("emisor"),
        _text(s, "X509SerialNumber").alias("serie"),
        _text(s, "Identifier").alias("politica_id"),
        _text(s, "MimeType").alias("tipo_mime"),
        F.regexp_count(s, F.lit(r"<(?:\w+:)?RevocationValues[\s>/]")).cast("bigint").alias("revocaciones"),
    ).withColumn("valida", F.col("tiene_signed_info"))


def xades_summary(sri_xml: DataFrame) -> DataFrame:
    """Per document: signatures, valid ones, those with certificates, timestamps and policies."""
    n = F.count(F.lit(1))
    found = xades_signatures(sri_xml).groupBy("clave").agg(
        n.alias("total_firmas"),
        F.count_if("valida").alias("firmas_validas"),
        F.count_if(~F.col("valida")).alias("firmas_invalidas"),
        F.count_if(F.col("certificados") > 0).alias("con_certificados"),
        F.count_if(F.col("timestamps") > 0).alias("con_timestamps"),
        F.count_if(F.col("politicas") > 0).alias("con_politicas"),
    )
    counts = [c for c in found.columns if c != "clave"]
    out = sri_xml.select("clave").join(found, "clave", "left").fillna(0, counts)
    return out.withColumn(
        "porcentaje_validas", F.when(F.col("total_firmas") > 0, F.col("firmas_validas") / F.col("total_firmas") * 100).otherwise(0.0)
    )


def cert_ok(certificates: DataFrame, now: str) -> DataFrame:
    """(…, not_before, not_after, subject) valid at `now`; a missing window passes, a missing name does not."""
    at = F.lit(now).cast("timestamp_ntz")
    begin, end = (F.col(c).try_cast("timestamp_ntz") for c in ("not_before", "not_after"))
    stated = (F.coalesce("not_before", F.lit("")) != "") & (F.coalesce("not_after", F.lit("")) != "")
    inside = F.coalesce((at >= begin) & (at <= end), F.lit(False))
    named = F.coalesce("subject", F.lit("")) != ""
    return certificates.withColumn("valido", (~stated | inside) & named)


def signature_kind(total: Column, valid: Column, crypto: Column, chain: Column) -> list[Column]:
    """Type by number and checks, and security level by how many signatures pass them."""
    kind = (
        F.when(total == 0, "ninguno")
        .when(total > 1, "multiple")
        .when((crypto > 0) & (chain > 0), "cualificada")
        .when(crypto > 0, "avanzada")
        .otherwise("basica")
    )
    all_valid = (total > 0) & (valid == total)
    level = (
        F.when(all_valid & (crypto == total) & (chain == total), "cualificado")
        .when(all_valid & (crypto == total), "avanzado")
        .when(all_valid, "basico")
        .when(total > 0, "parcial")
        .otherwise("ninguno")
    )
    return [kind.alias("tipo"), level.alias("nivel")]


def signature_verdict(pdf_docs: DataFrame, xml_docs: DataFrame) -> DataFrame:
    """Signed or not, per document, for both kinds of file.

    pdf_docs: doc_id, basica, por_patrones, confianza, tipo_patron, verificada boolean (null when
    signatures were not parsed), total, validas, crypto, chain, pades, es_ride, autorizado.
    xml_docs: doc_id, total, validas, es_documento_sri, autorizado.
    """
    p = pdf_docs.select(
        "doc_id",
        F.lit("pdf").alias("documento"),
        F.coalesce("verificada", F.col("basica") | F.col("por_patrones")).alias("firma_detectada"),
        F.col("tipo_patron").alias("tipo_firma"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total_firmas"),
        F.coalesce("validas", F.lit(0)).cast("bigint").alias("firmas_validas"),
        (F.coalesce("pades", F.lit(0)) > 0).alias("es_pades"),
        F.col("es_ride").alias("es_documento_sri"),
        "autorizado",
        *signature_kind(*[F.coalesce(c, F.lit(0)) for c in ("total", "validas", "crypto", "chain")]),
    )
    signed = F.col("total") > 0
    x = xml_docs.select(
        "doc_id",
        F.lit("xml").alias("documento"),
        signed.alias("firma_detectada"),
        F.when(signed, "xades").otherwise("ninguna").alias("tipo_firma"),
        F.col("total").cast("bigint").alias("total_firmas"),
        F.col("validas").cast("bigint").alias("firmas_validas"),
        F.lit(False).alias("es_pades"),
        "es_documento_sri",
        F.when(F.col("es_documento_sri"), F.col("autorizado")).alias("autorizado"),
        *signature_kind(F.col("total"), F.col("validas"), F.lit(0), F.lit(0)),
    )
    return p.unionByName(x)
