"""Invoice arithmetic: lines, tax, totals, anomalies and the financial score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.numbers import (
    DISCOUNT_KEYS, IVA_KEYS, RETENTION_KEYS, SUBTOTAL_KEYS, TIP_KEYS, TOTAL_KEYS, pick_field, truthy,
)

LINE_TOLERANCE = 0.02
# Accepted VAT rates in percent.
VAT_BANDS = [0.0, 5.0, 8.0, 12.0, 15.0]


def _zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def _line_base() -> Column:
    return _zero("cantidad") * _zero("precio_unitario") - _zero("descuento")


def item_totals(items: DataFrame) -> DataFrame:
    """Sum of line totals per document and source."""
    return items.groupBy("doc_id", "source").agg(F.round(F.sum(_zero("precio_total")), 2).alias("total_items"))


def item_total_difference(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Both sides' sums on one row; `difiere` only when both sides have items."""
    side = lambda s: F.round(F.sum(F.when(F.col("source") == s, _zero("precio_total"))), 2)
    both = items.groupBy("doc_id").agg(side("sri").alias("total_sri"), side("pdf").alias("total_pdf"))
    return both.withColumn("difiere", F.coalesce(F.abs(F.col("total_sri") - F.col("total_pdf")) > tolerance, F.lit(False)))


def line_status(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Per line: base, difference to the reported total and verdict; a missing total passes.

    A zero reported total counts as missing, as does the line VAT only when it is null.
    """
    reported = truthy(F.col("precio_total"))
    base = _line_base()
    diff = base + _zero("iva") - reported
    return items.withColumn("base_calc", base).withColumn("diferencia", F.round(diff, 2)).withColumn(
        "linea_ok", F.coalesce(F.abs(diff) <= tolerance, F.lit(True))
    )


def check_lines(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Per document: lines, valid lines and the base of the valid ones."""
    return line_status(items, tolerance).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("linea_ok").alias("items_validos"),
        F.count_if(~F.col("linea_ok")).alias("items_con_errores"),
        F.round(F.coalesce(F.sum(F.when(F.col("linea_ok"), F.col("base_calc"))), F.lit(0.0)), 2).alias("subtotal_calculado"),
    )


def line_summary(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Everything the score needs from the lines in one pass and one shuffle of partial sums."""
    p, q = truthy(F.col("precio_unitario")), truthy(F.col("cantidad"))
    base = F.col("base_calc")
    has_rate = (base > 0) & F.coalesce(F.col("tarifa").isNotNull() | truthy(F.col("iva")).isNotNull(), F.lit(False))
    odd = lambda *tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return line_status(items, tolerance).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("linea_ok").alias("items_validos"),
        F.count_if(~F.col("linea_ok")).alias("items_con_errores"),
        F.round(F.coalesce(F.sum(F.when(F.col("linea_ok"), base)), F.lit(0.0)), 2).alias("subtotal_calculado"),
        F.round(F.sum(F.when(has_rate, _zero("iva"))), 2).alias("iva_lineas"),
        F.round(F.sum(F.when(has_rate, base)), 2).alias("base_lineas"),
        F.sum(odd(p > 10000, p < 0.01, q > 1000, q <= 0)).alias("anomalias_lineas"),
    )


def line_errors(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """The failing lines themselves, one row each."""
    return line_status(items, tolerance).where(~F.col("linea_ok"))


def vat_by_rate(items: DataFrame) -> DataFrame:
    """Base and tax per document and rate; the rate is stated or inferred from tax over base."""
    base = _line_base()
    inferred = F.when(truthy(F.col("iva")).isNotNull(), F.round(F.col("iva") / base * 100, 2))
    rated = items.where(base > 0).withColumn("_base", base).withColumn("tasa", F.coalesce("tarifa", inferred))
    return (
        rated.where(F.col("tasa").isNotNull())
        .groupBy("doc_id", "tasa")
        .agg(F.sum("_base").alias("base"), F.sum(_zero("iva")).alias("iva"))
    )


def _vat_verdict(joined: DataFrame, tolerance: float) -> dict[str, Column]:
    """Columns of the VAT verdict over subtotal, iva, subtotal_15, iva_15, iva_lineas and base_lineas."""
    iva_detail = F.coalesce("iva_lineas", F.when(F.col("subtotal_15").isNotNull(), F.round(_zero("iva_15"), 2)))
    base_detail = F.coalesce("base_lineas", F.round("subtotal_15", 2))
    effective = F.when(truthy(F.col("subtotal")).isNotNull(), F.round(F.col("iva") / F.col("subtotal") * 100, 2)).otherwise(0.0)
    on_base = F.when(truthy(base_detail).isNotNull(), F.round(_zero("iva") / base_detail * 100, 2))
    near_band = F.exists(F.array(*[F.lit(b) for b in VAT_BANDS]), lambda b: F.abs(effective - b) <= 0.5)
    known = iva_detail.isNotNull()
    return {
        "iva_coherente": F.when(known, F.abs(_zero("iva") - iva_detail) <= tolerance).otherwise(near_band),
        "porcentaje_iva": F.when(known, F.coalesce(on_base, effective)).otherwise(effective),
        "base_imponible": F.round(_zero("subtotal"), 2),
        "iva_calculado": F.coalesce(iva_detail, F.round(_zero("subtotal") * effective / 100, 2)),
        "iva_declarado": F.round(_zero("iva"), 2),
    }


def _with_text_rates(totals: DataFrame) -> DataFrame:
    for name in ("subtotal_15", "iva_15"):
        if name not in totals.columns:
            totals = totals.withColumn(name, F.lit(None).cast("double"))
    return totals


def vat_check(items: DataFrame, totals: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Is the declared VAT coherent with the lines, or else with a known rate?

    `totals` has doc_id, subtotal, iva and optionally subtotal_15 and iva_15 read from the text.
    """
    detail = vat_by_rate(items).groupBy("doc_id").agg(
        F.round(F.sum("iva"), 2).alias("iva_lineas"), F.round(F.sum("base"), 2).alias("base_lineas"), F.count(F.lit(1)).alias("_n")
    )
    joined = _with_text_rates(totals).join(detail, "doc_id", "left")
    n_rates = F.coalesce("_n", F.col("subtotal_15").isNotNull().cast("bigint"))
    verdict = _vat_verdict(joined, tolerance)
    return joined.select("doc_id", *[c.alias(n) for n, c in verdict.items()], n_rates.alias("tasas"))


def vat_of_xml() -> Column:
    """VAT of a parsed invoice: only taxes with code 2."""
    vat = F.filter("infoFactura.totalConImpuestos", lambda t: t["codigo"] == "2")
    return F.aggregate(vat, F.lit(0.0), lambda a, t: a + F.coalesce(t["valor"], F.lit(0.0)))


def total_of_xml() -> Column:
    """Grand total of a parsed invoice, else untaxed total plus all taxes, else null."""
    fact = F.col("infoFactura")
    taxes = F.aggregate(fact["totalConImpuestos"], F.lit(0.0), lambda a, t: a + F.coalesce(t["valor"], F.lit(0.0)))
    rebuilt = F.when(F.size(fact["totalConImpuestos"]) > 0, _zero(fact["totalSinImpuestos"]) + taxes)
    return F.coalesce(fact["importeTotal"], rebuilt)


def xml_vat(invoices: DataFrame) -> DataFrame:
    return invoices.select("clave", vat_of_xml().alias("iva"))


def xml_amounts(invoices: DataFrame) -> DataFrame:
    """Amounts of the official record in the layout of `consolidate_totals`."""
    fact = F.col("infoFactura")
    vat = F.filter(fact["totalConImpuestos"], lambda t: t["codigo"] == "2")
    return invoices.select(
        F.col("clave").alias("doc_id"),
        _zero(fact["totalSinImpuestos"]).alias("subtotal"),
        F.aggregate(vat, F.lit(0.0), lambda a, t: a + F.coalesce(t["valor"], F.lit(0.0))).alias("iva"),
        _zero(fact["totalDescuento"]).alias("descuentos"),
        F.lit(0.0).alias("retenciones"),
        _zero(fact["propina"]).alias("propina"),
        _zero(fact["importeTotal"]).alias("total_declarado"),
    )


def xml_total(invoices: DataFrame) -> DataFrame:
    return invoices.select("clave", total_of_xml().alias("valor_xml"))


def infer_totals(items: DataFrame) -> DataFrame:
    """Subtotal, VAT and total from the lines that have both price and quantity; null where nothing positive."""
    usable = truthy(F.col("precio_unitario")).isNotNull() & truthy(F.col("cantidad")).isNotNull()
    sums = items.where(usable).groupBy("doc_id").agg(F.sum(_line_base()).alias("_s"), F.sum(_zero("iva")).alias("_i"))
    return sums.select(
        "doc_id",
        F.when(F.col("_s") > 0, F.round("_s", 2)).alias("subtotal"),
        F.when(F.col("_i") > 0, F.round("_i", 2)).alias("iva"),
        F.when(F.col("_s") > 0, F.round(F.col("_s") + F.col("_i"), 2)).alias("total"),
    )


def parser_checks(totals: DataFrame, items: DataFrame, eps: float = LINE_TOLERANCE) -> DataFrame:
    """Tri-state checks of a captured invoice: item sum against subtotal, rebuilt total against total."""
    sums = items.groupBy("doc_id").agg(F.coalesce(F.sum("precio_total"), F.lit(0.0)).alias("sum_items"))
    parts = ("subtotal0", "subtotal15", "subtotal_no_objeto")
    rebuilt = F.when(
        F.coalesce(*parts).isNotNull(), _zero(parts[0]) + _zero(parts[1]) + _zero(parts[2]) - _zero("descuento") + _zero("iva15")
    )
    return totals.join(sums, "doc_id", "left").select(
        "doc_id",
        "sum_items",
        (F.abs(F.col("sum_items") - F.col("subtotal_sin_impuestos")) <= eps).alias("items_vs_subtotal"),
        rebuilt.alias("recomputed_total"),
        (F.abs(rebuilt - F.col("total")) <= eps).alias("recomputed_vs_total"),
    )


def consolidate_totals(fields: DataFrame, text_amounts: DataFrame, items: DataFrame) -> DataFrame:
    """One set of amounts per document from extracted fields, labelled text and lines.

    `fields` is (doc_id, fields map<string,string>), `text_amounts` the wide output of the label
    search. Zero counts as missing at every step of a chain. The total is the labelled candidate
    that agrees with the formula, else the only candidate, else the nearer one.
    """
    f = F.col("fields")
    base = (
        fields.join(text_amounts, "doc_id", "left")
        .join(check_lines(items).select("doc_id", "subtotal_calculado"), "doc_id", "left")
    )
    by_rate = ("subtotal_15", "subtotal_0", "subtotal_no_objeto", "subtotal_exento")
    sum_rates = F.when(F.coalesce(*by_rate).isNotNull(), sum((_zero(c) for c in by_rate), F.lit(0.0)))
    chain = lambda *cs: F.coalesce(*[truthy(c) for c in cs], F.lit(0.0))
    subtotal = chain(pick_field(f, SUBTOTAL_KEYS), F.coalesce(F.col("subtotal_sin_impuestos"), sum_rates), F.col("subtotal_calculado"))
    iva = chain(pick_field(f, IVA_KEYS), F.col("iva_15"))
    discount = chain(pick_field(f, DISCOUNT_KEYS), F.col("total_descuento"))
    retention = chain(pick_field(f, RETENTION_KEYS))
    tip = chain(pick_field(f, TIP_KEYS), F.col("propina"))
    amounts = base.select(
        "doc_id",
        subtotal.alias("subtotal"),
        iva.alias("iva"),
        discount.alias("descuentos"),
        retention.alias("retenciones"),
        tip.alias("propina"),
        F.col("valor_total").alias("_vt"),
        F.col("forma_pago_valor").alias("_fp"),
        pick_field(f, TOTAL_KEYS).alias("_pdf"),
        "subtotal_15",
        "iva_15",
    )
    return amounts.withColumn("total_declarado", _declared_total()).drop("_vt", "_fp", "_pdf")


def _formula() -> Column:
    return F.col("subtotal") - F.col("descuentos") + F.col("iva") + F.col("propina") - F.col("retenciones")


def _declared_total() -> Column:
    vt, fp = F.col("_vt"), F.col("_fp")
    dv, dp = F.abs(vt - _formula()), F.abs(fp - _formula())
    return (
        F.when(dv <= 0.25, vt)
        .when(dp <= 0.25, fp)
        .when(vt.isNotNull() & fp.isNull(), vt)
        .when(fp.isNotNull() & vt.isNull(), fp)
        .when(vt.isNotNull() & fp.isNotNull(), F.when(dv <= dp, vt).otherwise(fp))
        .otherwise(F.coalesce(truthy(F.col("_pdf")), F.lit(0.0)))
    )


def prefer_xml(amounts: DataFrame, xml: DataFrame) -> DataFrame:
    """Official amounts replace extracted ones wherever the record exists."""
    names = ["subtotal", "iva", "descuentos", "retenciones", "propina", "total_declarado"]
    x = xml.select("doc_id", F.lit(True).alias("_xml"), *[F.col(n).alias(f"_x_{n}") for n in names])
    joined = amounts.join(x, "doc_id", "left")
    return joined.select(
        "doc_id",
        *[F.when(F.col("_xml"), F.col(f"_x_{n}")).otherwise(F.col(n)).alias(n) for n in names],
        *[c for c in ("subtotal_15", "iva_15") if c in amounts.columns],
        F.when(F.col("_xml"), "xml_sri_oficial").otherwise("lineas_con_ventana").alias("metodo_usado"),
    )


def complete_amounts(subtotal: Column, iva: Column, total: Column) -> list[Column]:
    """Fill the one missing amount of three; zero counts as missing."""
    s, i, t = truthy(subtotal), truthy(iva), truthy(total)
    gap = t - s
    new_total = F.when(s.isNotNull() & i.isNotNull() & t.isNull(), F.round(s + i, 2)).otherwise(total)
    new_iva = F.when(t.isNotNull() & s.isNotNull() & i.isNull() & gap.between(F.lit(0.0), s * 0.20), F.round(gap, 2)).otherwise(iva)
    new_sub = F.when(t.isNotNull() & i.isNotNull() & s.isNull() & (t - i > 0), F.round(t - i, 2)).otherwise(subtotal)
    return [new_sub.alias("subtotal"), new_iva.alias("iva"), new_total.alias("total")]


def fallback_totals(context: DataFrame, inferred: DataFrame, tail: DataFrame, stats: DataFrame, fields: DataFrame) -> DataFrame:
    """Amounts for documents where neither subtotal nor VAT was found.

    context: (doc_id, subtotal, iva, total) from words on the line; inferred: from the items;
    tail: (doc_id, total) best candidate of the last lines; stats: (doc_id, total, subtotal, iva)
    from the largest amounts; fields: (doc_id, total, subtotal) loosely named fields. Items only
    replace a context value they agree with (0.05). The last resort starts from the fields.
    """
    names = ("subtotal", "iva", "total")
    ctx = context.select("doc_id", *[F.col(n).alias(f"c_{n}") for n in names])
    inf = inferred.select("doc_id", *[F.col(n).alias(f"i_{n}") for n in names])
    joined = (
        ctx.join(inf, "doc_id", "full")
        .join(tail.select("doc_id", F.col("total").alias("t_total")), "doc_id", "full")
        .join(stats.select("doc_id", *[F.col(n).alias(f"s_{n}") for n in names]), "doc_id", "full")
        .join(fields.select("doc_id", F.col("total").alias("f_total"), F.col("subtotal").alias("f_subtotal")), "doc_id", "full")
    )
    merged = {
        n: F.when(F.col(f"c_{n}").isNull() | (F.abs(F.col(f"c_{n}") - F.col(f"i_{n}")) <= 0.05), F.coalesce(f"i_{n}", f"c_{n}"))
        .otherwise(F.col(f"c_{n}"))
        for n in names
    }
    total = F.coalesce(truthy(merged["total"]), F.col("t_total"))
    first = joined.withColumn("_f", F.struct(*complete_amounts(merged["subtotal"], merged["iva"], total)))
    found = F.coalesce(F.col("_f.subtotal"), F.col("_f.iva"), F.col("_f.total")).isNotNull()
    # last resort: loosely named fields, else the largest amounts, then a 15% split of the total
    has_field = F.coalesce("f_total", "f_subtotal").isNotNull()
    lr_total = F.when(has_field, F.col("f_total")).otherwise(F.col("s_total"))
    lr_sub = F.when(has_field, F.col("f_subtotal")).otherwise(F.col("s_subtotal"))
    lr_iva = F.when(has_field, F.lit(None).cast("double")).otherwise(F.col("s_iva"))
    split = lr_total / 1.15
    exact = F.abs(split - F.round(split, 2)) < 0.01
    needs = truthy(lr_total).isNotNull() & truthy(lr_sub).isNull()
    resort_sub = F.when(needs & exact, F.round(split, 2)).when(needs, lr_total).otherwise(lr_sub)
    resort_iva = F.when(needs & exact, F.round(lr_total - split, 2)).when(needs, F.lit(0.0)).otherwise(lr_iva)
    return first.select(
        "doc_id",
        F.when(found, F.col("_f.subtotal")).otherwise(resort_sub).alias("subtotal"),
        F.when(found, F.col("_f.iva")).otherwise(resort_iva).alias("iva"),
        F.when(found, F.col("_f.total")).otherwise(lr_total).alias("total"),
        F.when(found, "contexto").when(F.coalesce(lr_total, lr_sub).isNotNull(), "ultimo_recurso").alias("metodo"),
    )


def check_formula(totals: DataFrame) -> DataFrame:
    """subtotal - discount + VAT + tip - retention against the declared total."""
    calc = _zero("subtotal") - _zero("descuentos") + _zero("iva") + _zero("propina") - _zero("retenciones")
    declared = _zero("total_declarado")
    diff = F.abs(declared - calc)
    tolerance = F.greatest(F.lit(0.02), declared * 0.001)
    return totals.select(
        "doc_id",
        (diff <= tolerance).alias("formula_correcta"),
        F.round(calc, 2).alias("total_calculado"),
        F.round(declared, 2).alias("total_declarado"),
        F.round(diff, 2).alias("diferencia"),
        F.round(tolerance, 2).alias("tolerancia"),
    )


def anomalies(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Implausible totals, prices and quantities as rows; zero values raise nothing."""
    t = truthy(F.col("total_declarado"))
    p, q = truthy(F.col("precio_unitario")), truthy(F.col("cantidad"))
    none = F.lit(None).cast("bigint")
    of_total = totals.select(
        "doc_id", none.alias("item_no"), F.when(t > 100000, "total_alto").when(t < 1, "total_bajo").alias("anomalia"), t.alias("valor")
    )
    # one pass over the lines yields both kinds
    kinds = F.array(
        F.struct(F.when(p > 10000, "precio_alto").when(p < 0.01, "precio_bajo").alias("anomalia"), p.alias("valor")),
        F.struct(F.when(q > 1000, "cantidad_alta").when(q <= 0, "cantidad_invalida").alias("anomalia"), q.alias("valor")),
    )
    of_lines = items.select("doc_id", F.col("item_no").cast("bigint").alias("item_no"), F.explode(kinds).alias("_k")).select(
        "doc_id", "item_no", "_k.anomalia", "_k.valor"
    )
    return of_total.unionByName(of_lines).where(F.col("anomalia").isNotNull())


def document_findings(totals: DataFrame, items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Formula, line, VAT and anomaly findings of every document; the lines are read once."""
    joined = _with_text_rates(totals).join(line_summary(items, tolerance), "doc_id", "left")
    calc = _zero("subtotal") - _zero("descuentos") + _zero("iva") + _zero("propina") - _zero("retenciones")
    declared = _zero("total_declarado")
    diff = F.abs(declared - calc)
    t = truthy(F.col("total_declarado"))
    n = lambda c: F.coalesce(c, F.lit(0))
    verdict = _vat_verdict(joined, tolerance)
    return joined.select(
        "doc_id",
        (diff <= F.greatest(F.lit(0.02), declared * 0.001)).alias("formula_correcta"),
        F.round(diff, 2).alias("diferencia"),
        n("total_items").alias("total_items"),
        n("items_validos").alias("items_validos"),
        n("items_con_errores").alias("items_con_errores"),
        verdict["iva_coherente"].alias("iva_coherente"),
        verdict["porcentaje_iva"].alias("porcentaje_iva"),
        (n("anomalias_lineas") + F.coalesce(((t > 100000) | (t < 1)).cast("int"), F.lit(0))).alias("total_anomalias"),
        F.abs(_zero("subtotal_calculado") - _zero("subtotal")).alias("diferencia_subtotal"),
    )


def financial_score(totals: DataFrame, items: DataFrame) -> DataFrame:
    """100 less 30 for the formula, 20 for bad lines, 15 for VAT and 5 per anomaly up to 20; valid from 70."""
    found = document_findings(totals, items)
    bad, odd = F.col("items_con_errores"), F.col("total_anomalias")
    sub_warn = F.col("diferencia_subtotal") > F.lit(0.02) + F.col("total_items") * 0.005
    score = F.greatest(
        F.lit(0),
        F.lit(100)
        - F.when(~F.col("formula_correcta"), 30).otherwise(0)
        - F.when(bad > 0, 20).otherwise(0)
        - F.when(~F.col("iva_coherente"), 15).otherwise(0)
        - F.least(F.lit(20), odd * 5),
    )
    return found.select(
        "doc_id",
        score.cast("int").alias("score_validacion"),
        (score >= 70).alias("es_valido"),
        "total_items",
        "items_validos",
        "formula_correcta",
        "iva_coherente",
        "total_anomalias",
        F.when(F.col("formula_correcta"), 0).otherwise(1).cast("bigint").alias("total_errores"),
        (bad + sub_warn.cast("int") + (~F.col("iva_coherente")).cast("int")).cast("bigint").alias("total_advertencias"),
        F.round("diferencia_subtotal", 2).alias("diferencia_subtotal"),
    )


def math_consistency(documents: DataFrame) -> DataFrame:
    """Internal coherence of one document's amounts, errors and warnings counted into a 0-100 metric.

    `documents`: doc_id, subtotal, iva, descuentos, total_declarado (read from the page),
    total_extraido (from the fields), fecha_emision date, n_numeros_grandes, n_montos_repetidos,
    n_totales (different total candidates), totales_rango (their spread), items_analizados,
    items_validos.
    """
    s, i, d, t = (_zero(c) for c in ("subtotal", "iva", "descuentos", "total_declarado"))
    formula_ok = F.abs(s + i - d - t) <= 0.05
    share = F.when((s > 0) & (i > 0), i / s * 100)
    vat_ok = F.coalesce((F.abs(share - 15) <= 2) | (F.abs(share - 12) <= 2) | (F.abs(share) <= 0.5), F.lit(True))
    visual = F.coalesce(F.abs(_zero("total_extraido") - t) > 0.1, F.lit(False))
    recent = F.year("fecha_emision") >= 2020
    odd_by_year = F.coalesce(recent & F.col("total_extraido").isNotNull() & ((F.col("total_extraido") < 0.10) | (F.col("total_extraido") > 100000)), F.lit(False))
    odd_by_year = odd_by_year & (_zero("total_extraido") != 0)
    no_total = t <= 0
    round_total = (t > 100) & (t == F.floor(t))
    repeated = _zero(F.col("n_montos_repetidos").cast("double")) > 0
    vat_high = F.coalesce(share > 20, F.lit(False))
    vat_low = F.coalesce((share > 0) & (share < 1), F.lit(False))
    several = _zero(F.col("n_totales").cast("double")) > 1
    spread = several & (_zero("totales_rango") > 1.0)
    count = lambda *flags: sum((f.cast("int") for f in flags), F.lit(0))
    # anomalies that count as critical also count as errors
    errors = count(~formula_ok, visual, ~vat_ok, spread, no_total, vat_high)
    warnings = count(_zero(F.col("n_numeros_grandes").cast("double")) > 0, odd_by_year)
    odd = count(no_total, round_total, repeated, vat_high, vat_low, several, visual)
    valid_share = F.when(_zero(F.col("items_analizados").cast("double")) > 0, F.col("items_validos") / F.col("items_analizados") * 100)
    bonus = count(formula_ok, vat_ok) * 5 + F.when(valid_share >= 95, 10).when(valid_share >= 80, 5).otherwise(0)
    metric = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - errors * 15 - warnings * 5 - odd * 10 + bonus))
    return documents.select(
        "doc_id",
        formula_ok.alias("formula_correcta"),
        vat_ok.alias("iva_coherente"),
        errors.cast("bigint").alias("errores"),
        warnings.cast("bigint").alias("advertencias"),
        odd.cast("bigint").alias("anomalias"),
        metric.cast("int").alias("metrica_consistencia"),
        (metric >= 70).alias("valido"),
    )


def pick_amounts(fields: DataFrame, keys: Sequence[tuple[str, list[str]]]) -> DataFrame:
    """First numeric field per alias list, as columns."""
    return fields.select("doc_id", *[pick_field(F.col("fields"), aliases).alias(name) for name, aliases in keys])
