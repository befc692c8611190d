"""Risk of PDF documents: base checks, the invoice rule and the rule for other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.dates import issue_date, pdf_date, whole_days
from cotejo.operators import scoring
from cotejo.sources.config import DEFAULT_WEIGHTS

MAX_DAYS = 10


def _weights(weights: DataFrame, *more: str) -> DataFrame:
    """The weights of the known checks as one map row; the names bound its size."""
    known = weights.where(F.col("check_key").isin(*DEFAULT_WEIGHTS, *more)).groupBy("check_key").agg(F.max("weight").alias("weight"))
    return known.agg(F.map_from_entries(F.collect_list(F.struct("check_key", "weight"))).alias("_w"), F.lit(1).alias("_one"))


def _part(share: float, weight: Column) -> Column:
    """A share of a weight, cut to whole points."""
    return (weight * share).cast("int")


def pdf_risk_checks(docs: DataFrame, weights: DataFrame, invoice: bool = True, charge_medium: float = 1.0, max_days: int = MAX_DAYS) -> DataFrame:
    """Check rows of every document from one wide row of its signals.

    docs: doc_id, fecha_emision, creation_date, mod_date (as printed), productor_conocido, nivel_capas,
    fuentes, dominante, dpi_min, dpi_media, dpi_desviacion, filtros_raros int, alineacion, rotacion,
    has_forms, has_js, has_embedded, tiene_firma, firmas_validas, documento_integro, nivel_seguridad,
    startxref, encrypted, estructura_sospechosa (null = not assessed). One pass, no union.
    """
    w = lambda k: F.coalesce(F.try_element_at(F.col("_w"), F.lit(k)), F.lit(0))
    df = (
        docs.withColumn("_one", F.lit(1))
        .join(F.broadcast(_weights(weights)), "_one", "left")
        .withColumns({"_e": issue_date(F.col("fecha_emision")), "_c": pdf_date(F.col("creation_date")), "_m": pdf_date(F.col("mod_date"))})
    )
    days = F.abs(F.datediff(F.col("_c").cast("date"), F.col("_e")))
    issued = F.when(days.isNull() | (days > max_days), w("fecha_creacion_vs_emision")).otherwise(0)
    gap = whole_days(F.col("_m"), F.col("_c"))
    layers = F.when(F.col("nivel_capas") == "HIGH", w("capas_multiples")).when(F.col("nivel_capas") == "MEDIUM", _part(charge_medium, w("capas_multiples"))).otherwise(0)
    fw, dw, aw = w("consistencia_fuentes"), w("dpi_uniforme"), w("alineacion_texto")
    fonts, top = F.coalesce("fuentes", F.lit(0)), F.coalesce("dominante", F.lit(0.0))
    cv = F.when(F.col("dpi_media") > 0, F.col("dpi_desviacion") / F.col("dpi_media"))
    align, turn = F.coalesce("alineacion", F.lit(1.0)), F.coalesce("rotacion", F.lit(0.0))
    signed = w("firmas_pdf")
    signed = F.when(F.col("firmas_validas") > 0, _part(1.5, signed)).otherwise(signed)
    signed = F.when(~F.col("documento_integro"), _part(0.3, signed)).otherwise(signed)
    signed = F.when(F.col("nivel_seguridad") == "alto", _part(1.2, signed)).otherwise(signed)
    flag = lambda c, k: F.when(F.col(c), w(k)).otherwise(0)
    iw = w("actualizaciones_incrementales")
    checks = [
        ("prioritarias", "fecha_creacion_vs_emision", days, issued if invoice else F.lit(0)),
        ("prioritarias", "fecha_mod_vs_creacion", gap, F.when(gap != 0, w("fecha_mod_vs_creacion")).otherwise(0)),
        ("prioritarias", "software_conocido", F.col("productor_conocido"), F.when(F.col("productor_conocido"), 0).otherwise(w("software_conocido"))),
        ("prioritarias", "capas_multiples", F.col("nivel_capas"), layers),
        ("secundarias", "consistencia_fuentes", fonts, F.when((fonts > 2) | (top < 0.4), fw).when(top < 0.6, _part(0.6, fw)).otherwise(0)),
        ("secundarias", "dpi_uniforme", F.col("dpi_min"), F.when(F.col("dpi_min") < 90, dw).when(F.col("dpi_min").isNotNull() & (cv > 0.35), _part(0.6, dw)).otherwise(0)),
        ("secundarias", "compresion_estandar", F.col("filtros_raros"), F.when(F.coalesce("filtros_raros", F.lit(0)) > 0, w("compresion_estandar")).otherwise(0)),
        ("secundarias", "alineacion_texto", align, F.when((align < 0.7) | (turn > 0.2), aw).when((align < 0.85) | (turn > 0.1), _part(0.6, aw)).otherwise(0)),
        ("adicionales", "anotaciones_o_formularios", F.col("has_forms"), flag("has_forms", "anotaciones_o_formularios")),
        ("adicionales", "javascript_embebido", F.col("has_js"), flag("has_js", "javascript_embebido")),
        ("adicionales", "archivos_incrustados", F.col("has_embedded"), flag("has_embedded", "archivos_incrustados")),
        ("adicionales", "firmas_pdf", F.col("firmas_validas"), F.when(F.col("tiene_firma"), signed).otherwise(0)),
        ("adicionales", "actualizaciones_incrementales", F.col("startxref"), F.when(F.col("startxref") >= 3, iw).when(F.col("startxref") > 1, _part(0.6, iw)).otherwise(0)),
        ("adicionales", "cifrado_permisos_extra", F.col("encrypted"), flag("encrypted", "cifrado_permisos_extra")),
        ("adicionales", "estructura_sospechosa", F.col("estructura_sospechosa"), F.when(F.coalesce("estructura_sospechosa", F.lit(False)), w("capas_multiples")).otherwise(0)),
    ]
    return scoring.explode_checks(df, ["doc_id"], checks)


def probable_fake(docs: DataFrame) -> DataFrame:
    """Strong signs: confident layers, a modification more than a day off, overlaid repeated text.

    docs: doc_id, creation_date, mod_date, has_layers, confianza_capas, superpuesto, lineas_duplicadas.
    """
    c, m = pdf_date(F.col("creation_date")), pdf_date(F.col("mod_date"))
    layered = F.col("has_layers") & (F.col("confianza_capas") >= 0.7)
    moved = F.abs(whole_days(m, c)) > 1
    doubled = F.col("superpuesto") & (F.col("lineas_duplicadas") > 2)
    any_of = F.coalesce(layered, F.lit(False)) | F.coalesce(moved, F.lit(False)) | F.coalesce(doubled, F.lit(False))
    return docs.select("doc_id", any_of.alias("es_falso_probable"))


def document_risk(docs: DataFrame, weights: DataFrame, levels: DataFrame) -> DataFrame:
    """Any document without an authority record: the issue-date check does not apply."""
    return scoring.assign_level(scoring.score_documents(pdf_risk_checks(docs, weights, invoice=False)), levels)


def invoice_risk(docs: DataFrame, weights: DataFrame, levels: DataFrame, missing_signature_key: str = "firmas_digitales") -> DataFrame:
    """Base score plus the weight of a failed authority check and of a missing signature.

    Needs `sri_ok` (null counts as fine) and `firma_verificada` (null = not checked) next to the base
    signals. The base score is clamped before each addition, as is the result; a signature weight
    that does not exist adds nothing.
    """
    base = scoring.score_documents(pdf_risk_checks(docs, weights)).select("doc_id", F.col("score").alias("base"))
    w = F.broadcast(_weights(weights, missing_signature_key))
    df = docs.select("doc_id", "sri_ok", "firma_verificada").join(base, "doc_id").withColumn("_one", F.lit(1)).join(w, "_one", "left")
    weight = lambda k: F.coalesce(F.try_element_at(F.col("_w"), F.lit(k)), F.lit(0))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    sri = F.when(F.coalesce("sri_ok", F.lit(True)), 0).otherwise(weight("sri_verificacion"))
    signature = F.when(F.coalesce("firma_verificada", F.lit(True)), 0).otherwise(weight(missing_signature_key))
    scored = df.select("doc_id", "base", sri.alias("penalizacion_sri"), clamp(clamp(F.col("base") + sri) + signature).cast("int").alias("score"))
    return scoring.assign_level(scored, levels)
