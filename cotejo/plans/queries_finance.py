"""Registered queries on invoice arithmetic, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import finance
from cotejo.plans import invoice
from cotejo.plans.derived import ITEMS_SQL, LINES_SQL, TOTALS_SQL, invoice_items, invoice_totals
from cotejo.sources.config import default_levels

Q, SQL = {}, {}

VAT_SQL = """rates AS (
  SELECT doc_id, tarifa AS tasa, sum(cantidad * precio_unitario - descuento) AS base, sum(iva) AS iva
  FROM items WHERE cantidad * precio_unitario - descuento > 0 GROUP BY doc_id, tarifa
), vat AS (
  SELECT t.doc_id, t.subtotal, t.iva, d.iva_l, d.base_l, d.n,
         CASE WHEN t.subtotal <> 0 THEN round(t.iva / t.subtotal * 100, 2) ELSE 0 END AS eff
  FROM totals t LEFT JOIN (SELECT doc_id, round(sum(iva), 2) AS iva_l, round(sum(base), 2) AS base_l, count(*) AS n
                           FROM rates GROUP BY doc_id) d ON d.doc_id = t.doc_id
), vat_check AS (
  SELECT doc_id,
         CASE WHEN iva_l IS NOT NULL THEN abs(iva - iva_l) <= 0.02
              ELSE list_bool_or([abs(eff - b) <= 0.5 for b in [0.0, 5.0, 8.0, 12.0, 15.0]]) END AS iva_coherente,
         CASE WHEN iva_l IS NOT NULL THEN round(iva / base_l * 100, 2) ELSE eff END AS porcentaje_iva,
         coalesce(n, 0) AS tasas, round(iva, 2) AS iva_declarado, iva_l
  FROM vat
)"""
FORMULA_SQL = """formula AS (
  SELECT doc_id, abs(total_declarado - (subtotal + iva)) <= greatest(0.02::DOUBLE, total_declarado * 0.001::DOUBLE) AS formula_correcta,
         round(subtotal + iva, 2) AS total_calculado, round(total_declarado, 2) AS total_declarado,
         round(abs(total_declarado - (subtotal + iva)), 2) AS diferencia
  FROM totals
)"""
ANOMALY_SQL = """odd AS (
  SELECT doc_id, CAST(NULL AS BIGINT) AS item_no,
         CASE WHEN total_declarado > 100000 THEN 'total_alto' WHEN total_declarado < 1 AND total_declarado <> 0 THEN 'total_bajo' END AS anomalia
  FROM totals
  UNION ALL
  SELECT doc_id, item_no, CASE WHEN precio_unitario > 10000 THEN 'precio_alto' WHEN precio_unitario < 0.01 AND precio_unitario <> 0 THEN 'precio_bajo' END FROM items
  UNION ALL
  SELECT doc_id, item_no, CASE WHEN cantidad > 1000 THEN 'cantidad_alta' WHEN cantidad < 0 THEN 'cantidad_invalida' END FROM items
), anomalias AS (SELECT * FROM odd WHERE anomalia IS NOT NULL)"""
CHECK_SQL = """lines AS (
  SELECT doc_id, count(*) AS total_items, count(*) FILTER (ok) AS items_validos, count(*) FILTER (NOT ok) AS items_con_errores,
         round(coalesce(sum(base_calc) FILTER (ok), 0), 2) AS subtotal_calculado
  FROM status GROUP BY doc_id
)"""
ALL = f"{ITEMS_SQL}, {TOTALS_SQL}, {LINES_SQL}, {VAT_SQL}, {FORMULA_SQL}, {ANOMALY_SQL}, {CHECK_SQL}"


def q_invoice_formula(spark, d):
    return finance.check_formula(invoice_totals(spark, d)).drop("tolerancia")


SQL["invoice_formula"] = f"WITH {ITEMS_SQL}, {TOTALS_SQL}, {FORMULA_SQL} SELECT * FROM formula"


def q_invoice_level(spark, d):
    return invoice.invoice_levels(invoice_totals(spark, d), invoice_items(spark, d), default_levels(spark))


SQL["invoice_level"] = f"""WITH {ALL}, odds AS (SELECT doc_id, count(*) AS n FROM anomalias GROUP BY doc_id),
pen AS (
  SELECT f.doc_id,
         CASE WHEN formula_correcta THEN 0 ELSE 30 END + CASE WHEN coalesce(items_con_errores, 0) > 0 THEN 20 ELSE 0 END AS p1,
         CASE WHEN iva_coherente THEN 0 ELSE 15 END AS p2, least(20, coalesce(n, 0) * 5) AS p3,
         CAST(NOT formula_correcta AS INT) + CAST(coalesce(items_con_errores, 0) > 0 AS INT) + CAST(NOT iva_coherente AS INT)
           + CAST(coalesce(n, 0) > 0 AS INT) AS np
  FROM formula f LEFT JOIN lines USING (doc_id) JOIN vat_check USING (doc_id) LEFT JOIN odds USING (doc_id)
)
SELECT doc_id, least(100, p1 + p2 + p3) AS score, p1 AS penalty_prioritarias, p2 AS penalty_secundarias, p3 AS penalty_adicionales,
       np AS n_penalised, CASE WHEN p1 + p2 + p3 <= 25 THEN 'bajo' WHEN p1 + p2 + p3 <= 42 THEN 'medio' ELSE 'alto' END AS nivel
FROM pen"""


def q_line_check(spark, d):
    return finance.check_lines(invoice_items(spark, d))


SQL["line_check"] = f"WITH {ITEMS_SQL}, {LINES_SQL}, {CHECK_SQL} SELECT * FROM lines"


def q_line_errors(spark, d):
    return finance.line_errors(invoice_items(spark, d)).select("doc_id", "item_no", "diferencia")


SQL["line_errors"] = f"""WITH {ITEMS_SQL}, {LINES_SQL}
SELECT doc_id, item_no, round(base_calc + iva - precio_total, 2) AS diferencia FROM status WHERE NOT ok"""


def q_vat_by_rate(spark, d):
    rates = finance.vat_by_rate(invoice_items(spark, d))
    return rates.select("doc_id", F.round("tasa", 2).alias("tasa"), F.round("base", 2).alias("base"), F.round("iva", 2).alias("iva"))


SQL["vat_by_rate"] = f"""WITH {ITEMS_SQL}, {TOTALS_SQL}, {VAT_SQL}
SELECT doc_id, round(tasa, 2) AS tasa, round(base, 2) AS base, round(iva, 2) AS iva FROM rates"""


def q_vat_check(spark, d):
    checked = finance.vat_check(invoice_items(spark, d), invoice_totals(spark, d))
    return checked.select("doc_id", "iva_coherente", "porcentaje_iva", "tasas", "iva_declarado")


SQL["vat_check"] = f"""WITH {ITEMS_SQL}, {TOTALS_SQL}, {VAT_SQL}
SELECT doc_id, iva_coherente, porcentaje_iva, tasas, iva_declarado FROM vat_check"""


def q_infer_totals(spark, d):
    return finance.infer_totals(invoice_items(spark, d))


SQL["infer_totals"] = f"""WITH {ITEMS_SQL}
SELECT doc_id, CASE WHEN s > 0 THEN round(s, 2) END AS subtotal, CASE WHEN i > 0 THEN round(i, 2) END AS iva,
       CASE WHEN s > 0 THEN round(s + i, 2) END AS total
FROM (SELECT doc_id, sum(cantidad * precio_unitario - descuento) AS s, sum(iva) AS i FROM items
      WHERE cantidad <> 0 AND precio_unitario <> 0 GROUP BY doc_id)"""


def q_item_totals(spark, d):
    return finance.item_totals(invoice_items(spark, d))


SQL["item_totals"] = f"""WITH {ITEMS_SQL}
SELECT doc_id, 'pdf' AS source, round(sum(precio_total), 2) AS total_items FROM items GROUP BY doc_id"""


def q_anomalies(spark, d):
    return finance.anomalies(invoice_items(spark, d), invoice_totals(spark, d)).drop("valor")


SQL["anomalies"] = f"WITH {ITEMS_SQL}, {TOTALS_SQL}, {ANOMALY_SQL} SELECT doc_id, item_no, anomalia FROM anomalias"


def q_financial_score(spark, d):
    return finance.financial_score(invoice_totals(spark, d), invoice_items(spark, d)).drop("total_advertencias", "diferencia_subtotal")


SQL["financial_score"] = f"""WITH {ALL}, odds AS (SELECT doc_id, count(*) AS n FROM anomalias GROUP BY doc_id)
SELECT f.doc_id,
       greatest(0, 100 - CASE WHEN formula_correcta THEN 0 ELSE 30 END - CASE WHEN coalesce(items_con_errores, 0) > 0 THEN 20 ELSE 0 END
         - CASE WHEN iva_coherente THEN 0 ELSE 15 END - least(20, coalesce(n, 0) * 5)) AS score_validacion,
       100 - CASE WHEN formula_correcta THEN 0 ELSE 30 END - CASE WHEN coalesce(items_con_errores, 0) > 0 THEN 20 ELSE 0 END
         - CASE WHEN iva_coherente THEN 0 ELSE 15 END - least(20, coalesce(n, 0) * 5) >= 70 AS es_valido,
       coalesce(total_items, 0) AS total_items, coalesce(items_validos, 0) AS items_validos, formula_correcta, iva_coherente,
       coalesce(n, 0) AS total_anomalias, CASE WHEN formula_correcta THEN 0 ELSE 1 END AS total_errores
FROM formula f LEFT JOIN lines USING (doc_id) JOIN vat_check USING (doc_id) LEFT JOIN odds USING (doc_id)"""


def q_math_consistency(spark, d):
    totals = invoice_totals(spark, d).join(q_line_check(spark, d), "doc_id", "left")
    docs = totals.select(
        "doc_id", F.round("subtotal", 2).alias("subtotal"), F.round("iva", 2).alias("iva"), "descuentos", F.round("total_declarado", 2).alias("total_declarado"),
        (F.round("subtotal", 2) + F.round("iva", 2)).alias("total_extraido"),
        F.to_date("o_orderdate").alias("fecha_emision"),
        (F.col("doc_id") % 3).alias("n_numeros_grandes"), (F.col("doc_id") % 4).alias("n_montos_repetidos"),
        (F.col("doc_id") % 2 + 1).alias("n_totales"), ((F.col("doc_id") % 2) * 2.5).alias("totales_rango"),
        F.coalesce("total_items", F.lit(0)).alias("items_analizados"), F.coalesce("items_validos", F.lit(0)).alias("items_validos"),
    )
    return finance.math_consistency(docs)


SQL["math_consistency"] = f"""WITH {ITEMS_SQL}, {TOTALS_SQL}, {LINES_SQL}, {CHECK_SQL}, cents AS (
  SELECT doc_id, round(subtotal, 2) AS subtotal, round(iva, 2) AS iva, round(total_declarado, 2) AS total_declarado FROM totals
), x AS (
  SELECT t.doc_id, abs(subtotal + iva - total_declarado) <= 0.05 AS f,
         CASE WHEN subtotal > 0 AND iva > 0 THEN iva / subtotal * 100 END AS share,
         abs(subtotal + iva - total_declarado) > 0.1 AS visual, total_declarado AS td,
         CASE WHEN total_items > 0 THEN items_validos * 100.0 / total_items END AS vs,
         year(o_orderdate) >= 2020 AND subtotal + iva <> 0 AND (subtotal + iva < 0.1 OR subtotal + iva > 100000) AS by_year
  FROM cents t JOIN orders ON o_orderkey = t.doc_id LEFT JOIN lines USING (doc_id)
), y AS (
  SELECT doc_id, f, vs,
         coalesce(abs(share - 15) <= 2 OR abs(share - 12) <= 2 OR abs(share) <= 0.5, true) AS v,
         visual, td <= 0 AS no_total, td > 100 AND td = floor(td) AS rnd, doc_id % 4 > 0 AS rep,
         coalesce(share > 20, false) AS hi, coalesce(share > 0 AND share < 1, false) AS lo, doc_id % 2 = 1 AS many, by_year
  FROM x
), z AS (
  SELECT doc_id, f, v, vs,
         CAST(NOT f AS INT) + CAST(visual AS INT) + CAST(NOT v AS INT) + CAST(many AS INT) + CAST(no_total AS INT) + CAST(hi AS INT) AS e,
         CAST(doc_id % 3 > 0 AS INT) + CAST(by_year AS INT) AS w,
         CAST(no_total AS INT) + CAST(rnd AS INT) + CAST(rep AS INT) + CAST(hi AS INT) + CAST(lo AS INT) + CAST(many AS INT) + CAST(visual AS INT) AS a
  FROM y
), s AS (
  SELECT *, greatest(0, least(100, 100 - e * 15 - w * 5 - a * 10 + 5 * (CAST(f AS INT) + CAST(v AS INT))
              + CASE WHEN vs >= 95 THEN 10 WHEN vs >= 80 THEN 5 ELSE 0 END)) AS m FROM z
)
SELECT doc_id, f AS formula_correcta, v AS iva_coherente, e AS errores, w AS advertencias, a AS anomalias,
       m AS metrica_consistencia, m >= 70 AS valido FROM s"""

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
