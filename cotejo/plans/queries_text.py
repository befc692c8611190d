"""Registered queries on texts, identifiers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.functions import dates, ids, numbers, text as tx
from cotejo.functions.hashes import digests, hash_consistency
from cotejo.operators import extract, finance, lines as ln
from cotejo.plans.derived import ITEMS_SQL, KEYS_SQL, LINES_SQL, MOD11_SQL, TEXTS_SQL, access_keys, invoice_items, invoice_texts, table
from cotejo.skew import TASK_ROWS, at_least_parallel

Q, SQL = {}, {}
NL = "chr(10)"
_LINES = """lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> ''
)"""


#: documents of one task where they stay in their rows: they are dealt out anew, which writes every text to disk, only for lack of tasks
DOC_ROWS = 200_000


def _docs(spark, d, rows=TASK_ROWS):
    return at_least_parallel(table(spark, d, "documents"), rows).select("doc_id", F.lit("pdf").alias("source"), "text")


def q_duplicate_lines(spark, d):
    return ln.duplicate_lines(ln.split_lines(_docs(spark, d)))


SQL["duplicate_lines"] = f"WITH {_LINES} SELECT doc_id, line, count(*) AS veces FROM lines GROUP BY 1, 2 HAVING count(*) > 1"


def q_line_stats(spark, d):
    s = ln.line_stats(ln.split_lines(_docs(spark, d)))
    return s.withColumn("ratio_duplicacion", F.round("ratio_duplicacion", 6)).withColumn("largo_medio", F.round("largo_medio", 6))


SQL["line_stats"] = f"""WITH {_LINES}, g AS (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT doc_id, sum(n) AS total_lineas, count(*) AS lineas_unicas, count(*) FILTER (n > 1) AS lineas_duplicadas,
       round(1 - count(*) / sum(n), 6) AS ratio_duplicacion, round(sum(length(line) * n) / sum(n), 6) AS largo_medio,
       coalesce(sum(n) FILTER (length(line) <= 3 AND n > 5), 0) AS cortas_repetidas
FROM g GROUP BY doc_id"""


def q_line_format(spark, d):
    return ln.line_format(ln.split_lines(_docs(spark, d)))


SQL["line_format"] = rf"""WITH {_LINES}, g AS (
  SELECT doc_id, count(*) FILTER (regexp_matches(line, '\s{{10,}}')) AS espaciado,
         count(*) FILTER (regexp_matches(line, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS control,
         count(*) FILTER (regexp_matches(line, '[A-ZÁÉÍÓÚÑ]{{3,}}[a-záéíóúñ]+[A-ZÁÉÍÓÚÑ]{{3,}}')) AS pegado,
         count(*) FILTER (regexp_matches(line, '\d{{4,}}\s+[A-Za-z]{{1,3}}\s+[A-Za-z]')) AS numero_roto,
         count(*) FILTER (regexp_matches(line, '\w{{3,}}\s{{3,}}\w{{3,}}')) AS espacios_sueltos
  FROM lines GROUP BY doc_id
), s AS (SELECT doc_id, coalesce(sum(n) FILTER (length(line) <= 3 AND n > 5), 0) AS cortas_repetidas
         FROM (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY 1, 2) GROUP BY 1)
SELECT g.*, cortas_repetidas, CAST(espaciado > 0 AS BIGINT) + CAST(control > 0 AS BIGINT) + CAST(cortas_repetidas > 0 AS BIGINT) AS n_sospechas
FROM g JOIN s USING (doc_id)"""


def q_similar_lines(spark, d):
    return ln.similar_lines_in_texts(_docs(spark, d, DOC_ROWS)).select("doc_id", "i", "j", F.round("ratio", 6).alias("ratio"))


def q_text_overlap(spark, d):
    return ln.text_overlap_in_texts(_docs(spark, d, DOC_ROWS)).withColumn("probabilidad", F.round("probabilidad", 6))


def q_repeated_amounts(spark, d):
    return ln.repeated_amounts(invoice_texts(spark, d).unionByName(_docs(spark, d)), more_than=1)


SQL["repeated_amounts"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, t AS (SELECT doc_id, text FROM texts UNION ALL SELECT doc_id, text FROM documents)
SELECT doc_id, m AS monto, count(*) AS veces FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+[.,]\d{{2}}')) AS m FROM t)
GROUP BY 1, 2 HAVING count(*) > 1"""


def q_amount_stats(spark, d):
    return ln.amount_stats(invoice_texts(spark, d))


SQL["amount_stats"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, v AS (
  SELECT doc_id, list_reverse_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d+[.,]\d{{2}}'),
           lambda x: CAST(replace(x, ',', '.') AS DOUBLE)), lambda y: y >= 1))) AS v FROM texts
), w AS (SELECT doc_id, v[1] AS a, v[2] AS b FROM v)
SELECT doc_id, a AS total, CASE WHEN b >= a * 0.7::DOUBLE THEN b END AS subtotal,
       CASE WHEN b >= a * 0.7::DOUBLE THEN round(a - b, 2) END AS iva FROM w"""


def q_tail_candidates(spark, d):
    return ln.tail_candidates(invoice_texts(spark, d))


SQL["tail_candidates"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, l AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM texts
), e AS (
  SELECT doc_id, i, ls[CAST(i AS INT)] AS line, len(ls) AS n FROM l, range(1, 100) r(i) WHERE i <= len(ls) AND i > len(ls) - 15
), c AS (
  SELECT doc_id, i, n, line, unnest(regexp_extract_all(line, '\d+[.,]\d{{2}}')) AS m,
         generate_subscripts(regexp_extract_all(line, '\d+[.,]\d{{2}}'), 1) AS h FROM e
), s AS (
  SELECT *, CAST(replace(m, ',', '.') AS DOUBLE) AS v,
         CASE WHEN regexp_matches(lower(line), 'total|valor|importe|pagar') THEN 50 ELSE 0 END
         + CASE WHEN i - 1 >= n - 5 THEN 30 ELSE 0 END + CASE WHEN ends_with(line, m) THEN 20 ELSE 0 END
         - CASE WHEN regexp_matches(lower(line), 'mg|ml|gr|caps|unidad') THEN 50 ELSE 0 END AS score FROM c
), b AS (SELECT doc_id, v, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, h) AS r
         FROM s WHERE v >= 1 AND score > 20)
SELECT t.doc_id, v AS total, score AS puntaje FROM texts t LEFT JOIN b ON b.doc_id = t.doc_id AND r = 1"""


def q_label_next_lines(spark, d):
    return ln.label_next_lines(invoice_texts(spark, d)).select("doc_id", "subtotal_sin_impuestos", "iva_15", "valor_total", "forma_pago_valor")


_MONEY = r"(-?\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}})".replace("{{", "{").replace("}}", "}")
SQL["label_next_lines"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, l AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM texts
), e AS (SELECT doc_id, i, ls[CAST(i AS INT)] AS line FROM l, range(1, 60) r(i) WHERE i <= len(ls)),
m AS (
  SELECT doc_id, i, line, coalesce(
    list_filter(list_transform(regexp_extract_all(line, '{_MONEY}', 1), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda y: y >= 0)[1],
    list_filter(list_transform(regexp_extract_all(line, '(-?\d+[.,]\d{{2}})', 1), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda y: y >= 0)[1],
    list_filter(list_transform(regexp_extract_all(line, '(-?\d{{1,3}}(?:[.,]\d{{3}})+)', 1), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda y: y >= 0)[1],
    list_filter(list_transform(regexp_extract_all(line, '(-?\d+)', 1), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda y: y >= 0)[1]) AS v FROM e
), a AS (
  SELECT doc_id, i, line, coalesce(v, lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w) AS v3,
         coalesce(v, lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w, lead(v, 4) OVER w, lead(v, 5) OVER w, lead(v, 6) OVER w) AS v6
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)
SELECT doc_id,
  arg_min(v3, i) FILTER (v3 IS NOT NULL AND regexp_matches(line, '(?i)SUB\s*TOTAL\s*SIN\s*IMPUESTOS|BASE\s*IMPONIBLE|SUBTOTAL\s*GRAVADO')) AS subtotal_sin_impuestos,
  arg_min(v3, i) FILTER (v3 IS NOT NULL AND regexp_matches(line, '(?i)\bIVA\s*15%|IVA\s+15%|IVA\s*15\s*%|I\.V\.A\.?\s*15%?|IMPUESTO\s*15%')) AS iva_15,
  arg_min(v3, i) FILTER (v3 IS NOT NULL AND regexp_matches(line, '(?i)(?:VALOR|TOTAL|IMPORTE|MONTO)')) AS valor_total,
  arg_min(v6, i) FILTER (v6 IS NOT NULL AND regexp_matches(line, '(?i)\bFORMA\s*PAGO\b.*\bVALOR\b|FORMA\s*DE\s*PAGO.*VALOR|METODO\s*PAGO.*VALOR')) AS forma_pago_valor
FROM a GROUP BY doc_id"""


def q_consolidated_totals(spark, d):
    """Labelled text amounts, and the lines of the order where the text names no subtotal, consolidated and checked against the formula."""
    texts = invoice_texts(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("SUBTOTAL SIN IMPUESTOS"), F.lit("VARIOS"))).otherwise(F.col("text")))
    fields = texts.select("doc_id", F.create_map(F.lit("propina"), F.when(F.col("doc_id") % 2 == 0, "0,50").otherwise("x")).alias("fields"))
    out = finance.consolidate_totals(fields, ln.label_next_lines(texts), invoice_items(spark, d))
    return out.select("doc_id", F.round("subtotal", 2).alias("subtotal"), "iva", "propina", "total_declarado")


SQL["consolidated_totals"] = (
    SQL["label_next_lines"].replace("SELECT doc_id,\n  arg_min", ", x AS (SELECT doc_id,\n  arg_min", 1)
    .replace("AS ls FROM texts", "AS ls FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN replace(text, 'SUBTOTAL SIN IMPUESTOS', 'VARIOS') ELSE text END AS text FROM texts)")
    + f"""), {ITEMS_SQL}, {LINES_SQL}, z AS (SELECT doc_id, round(sum(base_calc) FILTER (ok), 2) AS calc FROM status GROUP BY 1),
y AS (SELECT x.doc_id, round(coalesce(nullif(subtotal_sin_impuestos, 0), nullif(calc, 0), 0), 2) AS s, coalesce(nullif(iva_15, 0), 0) AS i,
  CASE WHEN x.doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS p, valor_total AS vt, forma_pago_valor AS fp FROM x LEFT JOIN z USING (doc_id))
SELECT doc_id, s AS subtotal, i AS iva, p AS propina,
       CASE WHEN abs(vt - (s + i + p)) <= 0.25 THEN vt WHEN abs(fp - (s + i + p)) <= 0.25 THEN fp
            WHEN vt IS NOT NULL AND fp IS NULL THEN vt WHEN fp IS NOT NULL AND vt IS NULL THEN fp
            WHEN abs(vt - (s + i + p)) <= abs(fp - (s + i + p)) THEN vt ELSE fp END AS total_declarado FROM y"""
)


def q_context_amounts(spark, d):
    return ln.context_amounts(invoice_texts(spark, d))


def q_header_fields(spark, d):
    return extract.header_fields(invoice_texts(spark, d))


SQL["header_fields"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}
SELECT doc_id, regexp_extract(text, '(?i)\bRUC[:\s]*([0-9]{{13}})\b', 1) AS ruc,
       regexp_extract(strip_accents(text), '(?i)fecha\s*(?:de\s*)?emision[:\s]*([0-3]?\d[/-][01]?\d[/-]\d{{2,4}})', 1) AS "fechaEmision",
       split_part(text, chr(10), 1) || ' ' || split_part(text, chr(10), 2) AS "razonSocial" FROM texts"""


def q_invoice_amounts(spark, d):
    return extract.invoice_amounts(invoice_texts(spark, d)).withColumn("fuera_de_rango", F.array_join("fuera_de_rango", ","))


_AMT = r"[:\s]*\$?\s*([0-9]+[.,][0-9]{2})"
_first = lambda p: f"TRY_CAST(replace(regexp_extract(t, '(?i){p}', 1), ',', '.') AS DOUBLE)"


def _coalesced(patterns):
    return "coalesce(" + ", ".join(_first(p) for p in patterns) + ")"


SQL["invoice_amounts"] = f"WITH {KEYS_SQL}, {TEXTS_SQL}, s AS (SELECT doc_id, strip_accents(text) AS t FROM texts), a AS (SELECT doc_id, " + ", ".join(
    f'{_coalesced(patterns)} AS "{name}"' for name, (_, _, patterns) in extract.INVOICE_AMOUNTS.items()
) + """ FROM s)
SELECT *, array_to_string(list_filter([
  CASE WHEN "importeTotal" NOT BETWEEN 0.1 AND 15000 THEN 'importeTotal' END, CASE WHEN subtotal NOT BETWEEN 0.1 AND 10000 THEN 'subtotal' END,
  CASE WHEN iva NOT BETWEEN 0 AND 5000 THEN 'iva' END, CASE WHEN descuento NOT BETWEEN 0 AND 1000 THEN 'descuento' END], lambda x: x IS NOT NULL), ',') AS fuera_de_rango FROM a"""


def q_exhaustive_amounts(spark, d):
    df = extract.exhaustive_amounts(invoice_texts(spark, d))
    return df.select("doc_id", "subtotal", "iva", "total", "n_totales", F.round("totales_rango", 2).alias("totales_rango"))


def _hits_sql(amounts):
    """Hits of every pattern that DuckDB can run (it has no lookahead), as (doc_id, concepto, patron, hit, valor)."""
    rows = [
        f"SELECT doc_id, '{name}' AS concepto, {i} AS patron, unnest(l) AS m, generate_subscripts(l, 1) AS hit FROM (SELECT doc_id, regexp_extract_all(text, '(?im){p}', 1) AS l FROM texts)"
        for name, (_, _, patterns) in amounts.items() for i, p in enumerate(patterns) if "(?=" not in p
    ]
    return " UNION ALL ".join(rows)


SQL["exhaustive_amounts"] = f"""WITH {KEYS_SQL}, {TEXTS_SQL}, h AS (SELECT * EXCLUDE m, CAST(replace(m, ',', '.') AS DOUBLE) AS v FROM ({_hits_sql(extract.EXHAUSTIVE_AMOUNTS)})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, concepto ORDER BY patron, CASE WHEN concepto = 'total' THEN -v ELSE hit END) AS r FROM h)
SELECT t.doc_id, max(v) FILTER (concepto = 'subtotal' AND r = 1) AS subtotal, max(v) FILTER (concepto = 'iva' AND r = 1) AS iva, max(v) FILTER (concepto = 'total' AND r = 1) AS total,
  count(DISTINCT v) FILTER (concepto = 'total') AS n_totales, round(max(v) FILTER (concepto = 'total') - min(v) FILTER (concepto = 'total'), 2) AS totales_rango
FROM texts t LEFT JOIN r USING (doc_id) GROUP BY t.doc_id"""


def q_semantic_rules(spark, d):
    r = extract.semantic_rules(invoice_texts(spark, d))
    return r.select("doc_id", F.concat_ws(",", "fechas").alias("fechas"), "subtotal", "iva", "total", "amounts_consistent")


_AMOUNT = r"(?:\$?\s*)?(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|\d+(?:[.,]\d{2})?)"


def _norm_sql(x):
    """Every mark a dot, the last one decimal."""
    dots = f"replace({x}, ',', '.')"
    return (
        f"TRY_CAST(CASE WHEN len(string_split({dots}, '.')) > 2 THEN replace(left({dots}, length({dots}) - length(list_last(string_split({dots}, '.'))) - 1), '.', '')"
        f" || '.' || list_last(string_split({dots}, '.')) ELSE {dots} END AS DOUBLE)"
    )


def _kw(words):
    tries = ", ".join(_norm_sql(f"nullif(regexp_extract(text, '(?i){w}\\s*[:\\-]?\\s*{_AMOUNT}', 1), '')") for w in words)
    return f"coalesce({tries})"


SQL["semantic_rules"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, r AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
           regexp_extract_all(text, '\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})\b'), regexp_extract_all(text, '\b\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}\b')))), ',') AS fechas,
         {_kw(['subtotal', 'sub total'])} AS subtotal, {_kw(['iva', 'impuesto', 'tax', 'vat'])} AS iva,
         coalesce({_kw(['total', 'valor total', 'importe total'])},
                  list_max(list_transform(regexp_extract_all(text, '{_AMOUNT}', 1), lambda x: {_norm_sql('x')}))) AS total
  FROM texts
)
SELECT *, abs(subtotal + coalesce(iva, 0) - total) < greatest(0.02::DOUBLE, total * 0.01::DOUBLE) AS amounts_consistent FROM r"""


def q_extract_ids(spark, d):
    r = extract.extract_ids(invoice_texts(spark, d))
    return r.select("doc_id", *[F.concat_ws(",", c).alias(c) for c in ("cedulas", "rucs", "invalidos")])


_CED = """(substr({x}, 1, 2) BETWEEN '01' AND '24' AND (10 - (SELECT sum(CASE WHEN p > 9 THEN p - 9 ELSE p END) FROM (
  SELECT CAST(substr({x}, CAST(i AS INT), 1) AS BIGINT) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END AS p FROM range(1, 10) t(i))) % 10) % 10
  = CAST(substr({x}, 10, 1) AS BIGINT))"""
_M11 = "(SELECT CASE 11 - s % 11 WHEN 11 THEN 0 ELSE 11 - s % 11 END FROM (SELECT sum(CAST(substr({x}, CAST(i AS INT), 1) AS BIGINT) * [{w}][CAST(i AS INT)]) AS s FROM range(1, {n}) t(i)))"
_RUC = (
    "(substr({x}, 1, 2) BETWEEN '01' AND '24' AND CASE WHEN substr({x}, 3, 1) < '6' THEN ends_with({x}, '001') AND "
    + _CED
    + " WHEN substr({x}, 3, 1) = '6' THEN ends_with({x}, '0001') AND "
    + _M11.replace("{w}", "3, 2, 7, 6, 5, 4, 3, 2").replace("{n}", "9")
    + " = CAST(substr({x}, 9, 1) AS BIGINT) WHEN substr({x}, 3, 1) = '9' THEN ends_with({x}, '001') AND "
    + _M11.replace("{w}", "4, 3, 2, 7, 6, 5, 4, 3, 2").replace("{n}", "10")
    + " = CAST(substr({x}, 10, 1) AS BIGINT) ELSE false END)"
)
SQL["extract_ids"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, a AS (
  SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b\d{{10}}\b'))) AS c, list_sort(list_distinct(regexp_extract_all(text, '\b\d{{13}}\b'))) AS r FROM texts
), bad AS (
  SELECT doc_id, 1 AS k, x FROM (SELECT doc_id, unnest(c) AS x FROM a) WHERE NOT {_CED.replace('{x}', 'x')}
  UNION ALL SELECT doc_id, 2, x FROM (SELECT doc_id, unnest(r) AS x FROM a) WHERE NOT {_RUC.replace('{x}', 'x')}
), g AS (SELECT doc_id, string_agg(x, ',' ORDER BY k, x) AS b FROM bad GROUP BY 1)
SELECT a.doc_id, array_to_string(c, ',') AS cedulas, array_to_string(r, ',') AS rucs, coalesce(b, '') AS invalidos FROM a LEFT JOIN g USING (doc_id)"""


def q_access_key(spark, d):
    return extract.access_key(invoice_texts(spark, d)).select("doc_id", "clave")


SQL["access_key"] = rf"WITH {KEYS_SQL}, {TEXTS_SQL} SELECT doc_id, nullif(regexp_extract(text, '(\d{{49}})', 1), '') AS clave FROM texts"


def q_access_key_ocr(spark, d):
    """Keys of texts in which the recogniser read zeros as the letter O."""
    texts = invoice_texts(spark, d).withColumn("text", F.regexp_replace("text", r"(?<=ACCESO \d{8})0", "O"))
    return extract.access_key_ocr(texts).select("doc_id", "clave")


def q_access_key_form(spark, d):
    return extract.access_key_form(invoice_texts(spark, d)).select("doc_id", "clave")


def q_key_check(spark, d):
    """Check digit, parts and verdict of every order's key."""
    k = access_keys(spark, d)
    c, p = ids.key_check(F.col("clave")), ids.key_parts(F.col("clave"))
    return k.select("doc_id", c["ok"].alias("ok"), c["dv_calc"].cast("bigint").alias("dv_calc"), p["ruc"].alias("ruc"), p["secuencial"].alias("secuencial"), p["tipo_comprobante"].alias("tipo"))


SQL["key_check"] = f"""WITH {KEYS_SQL}, c AS (SELECT doc_id, clave, {MOD11_SQL.replace('{k}', 'clave')} AS dv FROM keys)
SELECT doc_id, dv = CAST(right(clave, 1) AS BIGINT) AS ok, dv AS dv_calc, substr(clave, 11, 13) AS ruc, substr(clave, 31, 9) AS secuencial, 'Factura' AS tipo FROM c"""


def q_key_repair(spark, d):
    """Keys cut to 48 digits for even orders; the rest as they are."""
    k = access_keys(spark, d).withColumn("clave", F.when(F.col("doc_id") % 2 == 0, F.substring("clave", 1, 48)).otherwise(F.col("clave")))
    return extract.repaired_key(k)


SQL["key_repair"] = f"""WITH {KEYS_SQL}, k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(clave, 1, 48) ELSE clave END AS c FROM keys),
f AS (SELECT doc_id, c, substr(c, 1, CAST(i AS INT) - 1) || r || substr(c, CAST(i AS INT) + 1) AS nk, i * 2 + (r = '7')::INT AS o
  FROM k, range(1, 49) p(i), (VALUES ('1'), ('7')) v(r) WHERE length(c) = 49 AND substr(c, CAST(i AS INT), 1) = '4'),
g AS (SELECT doc_id, arg_min(nk, o) AS nk FROM f WHERE {MOD11_SQL.format(k="nk")} = CAST(substr(nk, 49, 1) AS INT) GROUP BY doc_id),
d AS (SELECT doc_id, CASE WHEN length(c) = 48 THEN c || {MOD11_SQL.format(k="c")} WHEN {MOD11_SQL.format(k="c")} = CAST(substr(c, 49, 1) AS INT) THEN c ELSE coalesce(g.nk, c) END AS clave
  FROM k LEFT JOIN g USING (doc_id))
SELECT doc_id, clave, {MOD11_SQL.format(k="clave")} = CAST(substr(clave, 49, 1) AS INT) AS valida FROM d"""


def q_sri_format_check(spark, d):
    k = access_keys(spark, d).select("doc_id", F.col("clave").alias("claveAcceso"), F.when(F.col("doc_id") % 3 > 0, F.substring("clave", 11, 13)).alias("ruc"))
    return extract.sri_format_check(k)


SQL["sri_format_check"] = f"""WITH {KEYS_SQL}, c AS (SELECT doc_id, {MOD11_SQL.replace('{k}', 'clave')} = CAST(right(clave, 1) AS BIGINT) AS ok FROM keys)
SELECT doc_id, doc_id % 3 > 0 AND ok AS formato_valido,
       CASE WHEN doc_id % 3 = 0 THEN 'datos_insuficientes' WHEN NOT ok THEN 'clave_invalida' ELSE 'ok' END AS motivo FROM c"""


def q_authorization_number(spark, d):
    texts = invoice_texts(spark, d)
    keys = access_keys(spark, d).where(F.col("doc_id") % 8 == 0)
    attached = keys.select("doc_id", F.concat(F.lit("<autorizacion><numeroAutorizacion>"), "clave", F.lit("</numeroAutorizacion></autorizacion>")).alias("xml"))
    return extract.authorization_number(texts, attached)


SQL["authorization_number"] = f"""WITH {KEYS_SQL}
SELECT doc_id, CASE WHEN doc_id % 4 > 0 OR doc_id % 8 = 0 THEN clave END AS numero_autorizacion,
       CASE WHEN doc_id % 4 > 0 THEN 'cerca_de_etiqueta' WHEN doc_id % 8 = 0 THEN 'en_adjuntos_xml' END AS origen,
       CASE WHEN doc_id % 4 > 0 OR doc_id % 8 = 0 THEN 1 ELSE 0 END AS total_encontrados FROM keys"""


def q_capture_fields(spark, d):
    f = extract.capture_fields(invoice_texts(spark, d))
    return f.select("doc_id", "ruc", "invoice_number", "issue_datetime", "buyer_id")


SQL["capture_fields"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}
SELECT doc_id, regexp_extract(text, '(?i)\bR\.?\s*U\.?\s*C\.?\s*[:\s]*\s*([0-9]{{13}})', 1) AS ruc,
       regexp_extract(text, '([0-9]{{3}}-[0-9]{{3}}-[0-9]{{9}})', 1) AS invoice_number, regexp_extract(text, '(\d{{2}}/\d{{2}}/\d{{4}})', 1) AS issue_datetime,
       regexp_extract(text, '(?i)Identificaci[oó]n.*?[:\s]\s*([0-9A-Z\-]+)', 1) AS buyer_id FROM texts"""


def q_capture_amounts(spark, d):
    return extract.capture_amounts(invoice_texts(spark, d)).select("doc_id", "subtotal_sin_impuestos", "iva15", "total")


SQL["capture_amounts"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, m AS (SELECT doc_id, regexp_extract(text, '(?i)SUBTOTAL\s+SIN\s+IMPUESTOS\s*[:\s]\s*\$?\s*([0-9.,]+)', 1) AS s,
  regexp_extract(text, '(?i)IVA\s*15%?\s*[:\s]\s*\$?\s*([0-9.,]+)', 1) AS i, regexp_extract(text, '(?i)(?:VALOR\s+TOTAL|TOTAL\s*FACTURA|TOTAL)\s*[:\s]\s*\$?\s*([0-9.,]+)', 1) AS t FROM texts)
SELECT doc_id, CAST(nullif(s, '') AS DOUBLE) AS subtotal_sin_impuestos, CAST(nullif(i, '') AS DOUBLE) AS iva15, CAST(nullif(t, '') AS DOUBLE) AS total FROM m"""


def q_image_fields(spark, d):
    """Texts whose total has no blank after its sign, some with a company line."""
    k = F.col("doc_id")
    texts = invoice_texts(spark, d).withColumn("text", F.concat(F.when(k % 3 == 0, F.lit("Empresa: Andina\n")).otherwise(F.lit("")), F.replace("text", F.lit("$ "), F.lit("$"))))
    return extract.image_fields(texts)


SQL["image_fields"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}, t AS (SELECT doc_id, replace(text, '$ ', '$') AS t FROM texts)
SELECT doc_id, regexp_extract(t, '(?i)RUC[:\s]*(\d{{13}})', 1) AS ruc, CASE WHEN doc_id % 3 = 0 THEN 'Andina' END AS "razonSocial", nullif(regexp_extract(t, '(?i)Emisión[:\s]*(\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}})', 1), '') AS "fechaEmision",
  CAST(replace(nullif(regexp_extract(t, '(?i)Total[:\s]*\$?(\d+[.,]\d{{2}})', 1), ''), ',', '.') AS DOUBLE) AS "importeTotal", nullif(regexp_extract(t, '(\d{{49}})', 1), '') AS "claveAcceso" FROM t"""


def _forms(spark, d):
    """Printed electronic documents of several kinds, some with references to files."""
    k = F.col("doc_id")
    n = k.cast("string")
    prices = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.format_string("%.2f", "o_totalprice").alias("price"))
    text = F.concat_ws(
        "\n", F.when(k % 2 == 0, "RIDE"), F.concat(F.lit("RUC: "), F.substring("clave", 11, 13)),
        F.when(k % 3 == 1, "Tipo de Documento: NOTA DE CRÉDITO").when(k % 3 == 2, "Tipo de Documento: RETENCION"), F.concat(F.lit("Número de Autorización: "), n), F.concat(F.lit("Total: "), "price"),
        F.when(k % 5 > 0, F.concat(F.lit("Clave de Acceso: "), "clave")), F.when(k % 4 == 0, F.concat(F.lit("Archivo XML: f"), n, F.lit(".xml"))), F.when(k % 7 == 0, F.concat(F.lit("https://sri.example/"), n, F.lit(".xml"))),
    )
    return access_keys(spark, d).join(prices, "doc_id").select("doc_id", text.alias("text"))


def q_form_fields(spark, d):
    return extract.form_fields(_forms(spark, d)).select("doc_id", "tipo", "tipo_documento", "numero_autorizacion", "total", "clave_acceso", "ruc_emisor", "n_referencias", "n_marcas")


SQL["form_fields"] = f"""WITH {KEYS_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ride' WHEN doc_id % 3 = 1 THEN 'nota_credito' WHEN doc_id % 3 = 2 THEN 'retencion' ELSE 'documento_fiscal' END AS tipo,
  CASE doc_id % 3 WHEN 1 THEN 'NOTA DE CRÉDITO' WHEN 2 THEN 'RETENCION' END AS tipo_documento, CAST(doc_id AS VARCHAR) AS numero_autorizacion, printf('%.2f', o_totalprice) AS total, CASE WHEN doc_id % 5 > 0 THEN clave END AS clave_acceso,
  CASE WHEN doc_id % 2 = 0 THEN substr(clave, 11, 13) END AS ruc_emisor, (doc_id % 5 > 0)::INT + 2 * (doc_id % 4 = 0)::INT + 2 * (doc_id % 7 = 0)::INT AS n_referencias,
  2 + (doc_id % 2 = 0)::INT + (doc_id % 5 > 0)::INT AS n_marcas FROM keys JOIN orders ON o_orderkey = doc_id"""


def q_form_references(spark, d):
    return extract.form_references(_forms(spark, d))


SQL["form_references"] = f"""WITH {KEYS_SQL} SELECT doc_id, 'referencia_xml' AS tipo, clave AS valor FROM keys WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id, 'referencia_xml', 'f' || doc_id || '.xml' FROM keys, range(2) WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'url_archivo', p || '//sri.example/' || doc_id || '.xml' FROM keys, (VALUES ('https:'), ('')) v(p) WHERE doc_id % 7 = 0"""


def _plain_sql(pattern: str) -> str:
    return f"CAST(replace(nullif(regexp_extract(text, '(?i){pattern}', 1), ''), ',', '.') AS DOUBLE)"


def q_form_amounts(spark, d):
    return extract.form_amounts(invoice_texts(spark, d))


SQL["form_amounts"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL}
SELECT doc_id, {_plain_sql('(?:VALOR[ \t\n]+TOTAL|TOTAL)[^0-9]{0,30}([0-9]+[.,][0-9]{2})')} AS total, {_plain_sql('SUBTOTAL[ \t\n]+0%[: \t\n]*([0-9]+[.,][0-9]{2})')} AS subtotal_0,
  {_plain_sql('SUBTOTAL[ \t\n]+15%[: \t\n]*([0-9]+[.,][0-9]{2})')} AS subtotal_15, {_plain_sql('IVA[ \t\n]+15%[: \t\n]*([0-9]+[.,][0-9]{2})')} AS iva_15 FROM texts"""


def q_items_from_text(spark, d):
    """Order lines printed under a header, then read back."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("ARTICULO A"), F.col("l_partkey"), F.lit("X "), F.format_string("%.2f", "l_quantity"), F.lit(" "), F.format_string("%.2f", F.col("l_discount") * 100), F.lit(" "), F.format_string("%.2f", "l_extendedprice")).alias("line"),
    )
    docs = li.groupBy("doc_id").agg(F.concat(F.lit("DESCRIPCION\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("text"))
    return extract.items_from_text(docs).select("doc_id", "descripcion", "cantidad", "precio_unitario", "precio_total")


SQL["items_from_text"] = """SELECT l_orderkey AS doc_id, 'ARTICULO A' || CAST(l_partkey AS VARCHAR) || 'X' AS descripcion, l_quantity AS cantidad,
  CAST(printf('%.2f', l_discount * 100) AS DOUBLE) AS precio_unitario, l_extendedprice AS precio_total FROM lineitem"""


def q_text_hashes(spark, d):
    h = digests(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", h["md5"].alias("md5"), h["sha1"].alias("sha1"), h["sha256"].alias("sha256"))


SQL["text_hashes"] = "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents"


def q_accent_norm(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(tx.strip_accents(F.col("text"))).alias("plain"), F.md5(tx.norm_desc(F.col("text"))).alias("key"))


SQL["accent_norm"] = r"""SELECT doc_id, md5(strip_accents(text)) AS plain,
  md5(upper(trim(regexp_replace(regexp_replace(strip_accents(text), '[^A-Za-z0-9\s.-]', ' ', 'g'), '\s+', ' ', 'g')))) AS key FROM documents"""


def q_to_float(spark, d):
    """Printed prices in several spellings, read by each number rule."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    plain = F.format_string("%.2f", "o_totalprice")
    whole, cents = F.substring_index(plain, ".", 1), F.substring_index(plain, ".", -1)
    thousands = F.regexp_replace(whole, r"(\d+)(\d{3})$", "$1.$2")
    s = F.when(k % 3 == 0, plain).when(k % 3 == 1, F.concat(whole, F.lit(","), cents)).otherwise(F.concat(thousands, F.lit(","), cents))
    return o.select(k.alias("doc_id"), numbers.to_float(s).alias("a"), numbers.normalize_decimal(s).alias("b"), numbers.norm_amount(s).alias("c"), numbers.clean_amount(s, "mixed").alias("e"), numbers.first_money(s).alias("f"))


def _money_sql(x):
    tries = [
        f"list_filter(list_transform(regexp_extract_all({x}, '{p}', 1), lambda v: TRY_CAST(replace(v, ',', '.') AS DOUBLE)), lambda y: y >= 0)[1]"
        for p in numbers.MONEY_PATTERNS
    ]
    return f"coalesce({', '.join(tries)})"


SQL["to_float"] = rf"""WITH p AS (SELECT o_orderkey AS k, printf('%.2f', o_totalprice) AS t, o_totalprice AS v FROM orders), s AS (
  SELECT k, v, CASE k % 3 WHEN 0 THEN t WHEN 1 THEN replace(t, '.', ',') ELSE regexp_replace(split_part(t, '.', 1), '(\d+)(\d{{3}})$', '\1.\2') || ',' || split_part(t, '.', 2) END AS s FROM p)
SELECT k AS doc_id, TRY_CAST(replace(s, ',', '.') AS DOUBLE) AS a, v AS b, v AS c, v AS e, {_money_sql('s')} AS f FROM s"""


def q_date_parsing(spark, d):
    """Order dates printed as PDF, issue and image timestamps, then parsed."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pdf = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMM"), F.when(k % 2 == 0, F.date_format("o_orderdate", "dd")).otherwise("31"), F.lit("101530-05'00'"))
    issue = F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "d-M-yy"))
    meta = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00-05:00")))
    text = lambda c: c.cast("string")
    return o.select(k.alias("doc_id"), text(dates.pdf_date(pdf)).alias("pdf"), text(dates.issue_date(issue)).alias("emision"), text(dates.meta_date(meta)).alias("meta"))


SQL["date_parsing"] = """SELECT o_orderkey AS doc_id,
  strftime(o_orderdate, '%Y-%m-') || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d') WHEN day(last_day(o_orderdate)) = 31 THEN '31' ELSE '28' END || ' 10:15:30' AS pdf,
  CASE WHEN o_orderkey % 2 = 0 OR year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '20' || strftime(o_orderdate, '%y-%m-%d') END AS emision,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 2 THEN ' 08:00:00' ELSE ' 00:00:00' END AS meta FROM orders"""


def q_hash_consistency(spark, d):
    """Distances between three hashes cut from the digest of each text."""
    m = F.md5("text")
    c = hash_consistency(F.substring(m, 1, 16), F.substring(m, 17, 16), F.substring(m, 9, 16))
    return table(spark, d, "documents").select("doc_id", *[c[n].cast("bigint").alias(n) for n in ("phash_dhash", "phash_whash", "dhash_whash")], c["inconsistent"].alias("inconsistent"))


SQL["hash_consistency"] = """WITH h AS (SELECT doc_id, md5(text) AS m FROM documents), b AS (
  SELECT doc_id, CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS p, CAST('0x' || substr(m, 17, 16) AS UBIGINT) AS q, CAST('0x' || substr(m, 9, 16) AS UBIGINT) AS r FROM h
), x AS (SELECT doc_id, bit_count(xor(p, q)) AS a, bit_count(xor(p, r)) AS b, bit_count(xor(q, r)) AS c FROM b)
SELECT doc_id, a AS phash_dhash, b AS phash_whash, c AS dhash_whash, greatest(a, b, c) > 20 AS inconsistent FROM x"""

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
