"""Invoice XML and authorization responses as nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.functions.numbers import normalize_decimal
from cotejo.functions.text import clean_xml, strip

_TAX = "codigo: string, codigoPorcentaje: string, tarifa: string, baseImponible: string, valor: string"
XML_SCHEMA = (
    "infoTributaria struct<ambiente: string, tipoEmision: string, razonSocial: string, nombreComercial: string, "
    "ruc: string, claveAcceso: string, codDoc: string, estab: string, ptoEmi: string, secuencial: string, "
    "dirMatriz: string, agenteRetencion: string>, "
    "infoFactura struct<fechaEmision: string, dirEstablecimiento: string, obligadoContabilidad: string, "
    "tipoIdentificacionComprador: string, razonSocialComprador: string, identificacionComprador: string, "
    "direccionComprador: string, totalSinImpuestos: string, totalDescuento: string, "
    f"totalConImpuestos: struct<totalImpuesto: array<struct<{_TAX}>>>, propina: string, importeTotal: string, "
    "moneda: string, pagos: struct<pago: array<struct<formaPago: string, total: string, plazo: string, "
    "unidadTiempo: string>>>>, "
    "detalles struct<detalle: array<struct<codigoPrincipal: string, codigoAuxiliar: string, descripcion: string, "
    "cantidad: string, precioUnitario: string, descuento: string, precioTotalSinImpuesto: string, "
    f"impuestos: struct<impuesto: array<struct<{_TAX}>>>>>>, "
    "infoAdicional struct<campoAdicional: array<struct<_nombre: string, _VALUE: string>>>"
)
AUTHORIZED_STATES = ["AUTORIZADO", "AUTHORIZED", "VIGENTE", "VALID"]


def _num(c):
    return normalize_decimal(c, "xml")


def _text(c):
    return F.coalesce(strip(c), F.lit(""))


def _taxes(c, with_rate: bool):
    def one(t):
        fields = [_text(t["codigo"]).alias("codigo"), _text(t["codigoPorcentaje"]).alias("codigoPorcentaje")]
        if with_rate:
            fields.append(_num(t["tarifa"]).alias("tarifa"))
        return F.struct(*fields, _num(t["baseImponible"]).alias("baseImponible"), _num(t["valor"]).alias("valor"))

    return F.transform(F.coalesce(c, F.array()), one)


def read_invoice_xml(sri_xml: DataFrame) -> DataFrame:
    """(clave, xml) to (clave, infoTributaria, infoFactura, detalles, infoAdicional, parsed)."""
    # escaped bodies are unescaped first; real markup is parsed as it stands, entities included
    raw = F.col("xml")
    inner = F.regexp_replace(strip(raw), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    # bodies without blanks around them need no trimming of every character
    wrapped = raw.startswith("<![CDATA[") & raw.endswith("]]>") & (F.length(raw) >= 12)
    plain = F.when(wrapped, F.substr(raw, F.lit(10), F.length(raw) - 12)).when(raw.startswith("<") & raw.endswith(">"), raw).otherwise(inner)
    body = F.when(raw.contains("<factura"), plain).otherwise(clean_xml(raw))
    # a generator of one row keeps the optimizer from parsing again for every field and filter
    parsed = sri_xml.select("clave", F.explode(F.array(F.from_xml(body, XML_SCHEMA, {"rowTag": "factura", "mode": "PERMISSIVE"}))).alias("_x"))
    trib, fact = F.col("_x.infoTributaria"), F.col("_x.infoFactura")
    trib_names = [
        "ambiente", "tipoEmision", "razonSocial", "nombreComercial", "ruc", "claveAcceso", "codDoc", "estab",
        "ptoEmi", "secuencial", "dirMatriz", "agenteRetencion",
    ]
    fact_text = [
        "fechaEmision", "dirEstablecimiento", "obligadoContabilidad", "tipoIdentificacionComprador",
        "razonSocialComprador", "identificacionComprador", "direccionComprador", "moneda",
    ]
    fact_num = ["totalSinImpuestos", "totalDescuento", "propina", "importeTotal"]
    payments = F.transform(
        F.coalesce(fact["pagos"]["pago"], F.array()),
        lambda p: F.struct(
            _text(p["formaPago"]).alias("formaPago"),
            _num(p["total"]).alias("total"),
            _text(p["plazo"]).alias("plazo"),
            _text(p["unidadTiempo"]).alias("unidadTiempo"),
        ),
    )
    details = F.transform(
        F.coalesce(F.col("_x.detalles.detalle"), F.array()),
        lambda d: F.struct(
            *[_text(d[n]).alias(n) for n in ("codigoPrincipal", "codigoAuxiliar", "descripcion")],
            *[_num(d[n]).alias(n) for n in ("cantidad", "precioUnitario", "descuento", "precioTotalSinImpuesto")],
            _taxes(d["impuestos"]["impuesto"], True).alias("impuestos"),
        ),
    )
    extra = F.filter(F.coalesce(F.col("_x.infoAdicional.campoAdicional"), F.array()), lambda c: c["_nombre"] != "")
    # a repeated name keeps its last value, so later entries are written over earlier ones
    last_wins = F.filter(
        extra, lambda c, i: ~F.exists(F.slice(extra, i + 2, F.greatest(F.size(extra), F.lit(1))), lambda d: d["_nombre"] == c["_nombre"])
    )
    return parsed.select(
        "clave",
        F.struct(*[strip(trib[n]).alias(n) for n in trib_names]).alias("infoTributaria"),
        F.struct(
            *[strip(fact[n]).alias(n) for n in fact_text],
            *[_num(fact[n]).alias(n) for n in fact_num],
            _taxes(fact["totalConImpuestos"]["totalImpuesto"], False).alias("totalConImpuestos"),
            payments.alias("pagos"),
        ).alias("infoFactura"),
        details.alias("detalles"),
        F.map_from_entries(F.transform(last_wins, lambda c: F.struct(c["_nombre"], _text(c["_VALUE"])))).alias("infoAdicional"),
        (trib.isNotNull() | fact.isNotNull()).alias("parsed"),
    )


def xml_items(invoices: DataFrame) -> DataFrame:
    """Line items of parsed invoices in the common item layout, numbered from zero."""
    return invoices.select("clave", F.posexplode("detalles").alias("item_no", "_d")).select(
        F.col("clave").alias("doc_id"),
        F.lit("sri").alias("source"),
        F.col("item_no").cast("bigint"),
        F.col("_d.descripcion").alias("descripcion"),
        F.col("_d.cantidad").alias("cantidad"),
        F.col("_d.precioUnitario").alias("precio_unitario"),
        F.col("_d.descuento").alias("descuento"),
        F.col("_d.precioTotalSinImpuesto").alias("precio_total"),
        F.aggregate(
            F.filter("_d.impuestos", lambda t: t["codigo"] == "2"), F.lit(0.0), lambda a, t: a + F.coalesce(t["valor"], F.lit(0.0))
        ).alias("iva"),
        F.get(F.transform("_d.impuestos", lambda t: t["tarifa"]), F.lit(0)).alias("tarifa"),
    )


def parse_auth_json(responses: DataFrame, body: str = "respuesta") -> DataFrame:
    """Raw JSON answers where `autorizacion` may be one object or a list."""
    entry = "estado: string, numeroAutorizacion: string, fechaAutorizacion: string, ambiente: string, comprobante: string"
    node = F.get_json_object(body, "$.autorizaciones.autorizacion")
    listed = F.when(F.ltrim(node).startswith("["), node).when(node.isNotNull(), F.concat(F.lit("["), node, F.lit("]")))
    return responses.select("clave", F.coalesce(F.from_json(listed, f"array<struct<{entry}>>"), F.array()).alias("autorizaciones"))


def normalize_auth(sri_auth: DataFrame) -> DataFrame:
    """Authorized if any entry is; XML of the last authorized entry, else of the first that carries one."""
    entries = F.coalesce(F.col("autorizaciones"), F.array())
    state = lambda a: _text(a["estado"])
    good = F.filter(entries, lambda a: F.upper(state(a)).isin(AUTHORIZED_STATES))
    ok = F.size(good) > 0
    with_xml = F.filter(entries, lambda a: F.coalesce(a["comprobante"], F.lit("")) != "")
    first_state = F.get(F.filter(F.transform(entries, state), lambda s: s != ""), F.lit(0))
    return sri_auth.select(
        "clave",
        ok.alias("autorizado"),
        F.coalesce(first_state, F.when(ok, "AUTORIZADO").otherwise("SIN_ESTADO")).alias("estado"),
        F.when(ok, F.try_element_at(good, F.lit(-1))["comprobante"]).otherwise(F.get(with_xml, F.lit(0))["comprobante"]).alias("xml"),
        F.size(entries).alias("n_autorizaciones"),
    )
