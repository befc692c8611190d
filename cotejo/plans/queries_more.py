"""Registered queries on item parsers, fallbacks, official amounts and smaller verdicts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import config_tables, extract, finance, images, layers, signatures, tiles
from cotejo.operators import lines as ln
from cotejo.plans.derived import ITEMS_SQL, KEYS_SQL, TEXTS_SQL, access_keys, invoice_items, invoice_texts, table
from cotejo.plans.queries_boxes import invoice_xml
from cotejo.sources.config import DEFAULT_WEIGHTS, default_weights
from cotejo.sources.invoice_xml import read_invoice_xml

Q, SQL = {}, {}

# ---------------------------------------------------------------- item lines of recognised and photographed invoices


def _item_lines(spark, d):
    """Order lines with a code of letters as description and the unit price cut to cents; prices of any size."""
    letter = lambda div: F.expr(f"substr('BCDFGHJKLMNPQRSTVWXZ', cast(floor(l_partkey / {div}) % 20 as int) + 1, 1)")
    money = lambda c: F.format_string("%.2f", c)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("ARTICULO "), letter(1), letter(20), letter(400)).alias("name"), F.col("l_quantity").cast("int").cast("string").alias("qty"),
        money(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("unit"), money(F.col("l_extendedprice")).alias("total"), (F.col("l_partkey") + 10).cast("string").alias("code"),
    )


def _invoice_of(rows, line, head, tail):
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("text"))


_LINES = """l AS (
  SELECT l_orderkey AS doc_id, 'ARTICULO ' || substr('BCDFGHJKLMNPQRSTVWXZ', l_partkey % 20 + 1, 1) || substr('BCDFGHJKLMNPQRSTVWXZ', l_partkey // 20 % 20 + 1, 1) || substr('BCDFGHJKLMNPQRSTVWXZ', l_partkey // 400 % 20 + 1, 1) AS descripcion,
    l_quantity AS cantidad, floor(l_extendedprice / l_quantity * 100) / 100 AS unit, l_extendedprice AS total FROM lineitem)"""


def q_items_from_ocr(spark, d):
    docs = _invoice_of(_item_lines(spark, d), F.concat_ws(" ", "name", "qty", "unit", "total"), "FACTURA\nDETALLE\n", "\nSUBTOTAL 1.00")
    return extract.items_from_ocr(docs).select("doc_id", "descripcion", "cantidad", "precio_unitario", "precio_total")


SQL["items_from_ocr"] = f"WITH {_LINES} SELECT doc_id, descripcion, cantidad, unit AS precio_unitario, total AS precio_total FROM l"


def q_items_from_capture(spark, d):
    docs = _invoice_of(_item_lines(spark, d), F.concat_ws(" ", "code", F.lit("7"), "qty", "name", "unit", "total"), "COD CANT\n", "\nGRACIAS")
    return extract.items_from_capture(docs).select("doc_id", "descripcion", "cantidad", "precio_unitario", "precio_total")


SQL["items_from_capture"] = SQL["items_from_ocr"]


def q_items_from_image(spark, d):
    docs = _invoice_of(_item_lines(spark, d), F.concat(F.col("qty"), F.lit(" "), F.col("name"), F.lit(" $"), F.col("unit")), "FACTURA\n", "\nfin")
    return extract.items_from_image(docs).select("doc_id", "descripcion", "cantidad", "precio_total")


SQL["items_from_image"] = f"WITH {_LINES} SELECT doc_id, descripcion, cantidad, unit AS precio_total FROM l"


def q_big_numbers(spark, d):
    return ln.big_numbers(invoice_texts(spark, d))


SQL["big_numbers"] = rf"""WITH {KEYS_SQL}, {TEXTS_SQL} SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'codigo|product|item|ref') THEN 0
  ELSE len(regexp_extract_all(text, '\b\d{{6,}}\b')) END AS n_numeros_grandes FROM texts"""


# ---------------------------------------------------------------- totals


def q_parser_checks(spark, d):
    """Amounts of an order split by rate against the sum of its lines; some amounts are missing."""
    i = invoice_items(spark, d)
    k = F.col("doc_id")
    base = F.col("cantidad") * F.col("precio_unitario")
    sums = i.groupBy("doc_id").agg(F.round(F.sum(base), 2).alias("s"), F.round(F.sum("precio_total"), 2).alias("t"), F.round(F.sum("iva"), 2).alias("v"))
    totals = sums.select(
        "doc_id", F.when(k % 4 == 0, F.lit(1.5)).alias("subtotal0"), F.when(k % 5 > 0, F.col("s")).alias("subtotal15"), F.lit(None).cast("double").alias("subtotal_no_objeto"),
        F.when(k % 3 == 0, F.lit(0.25)).alias("descuento"), F.when(k % 7 > 0, F.col("v")).alias("iva15"), F.when(k % 6 > 0, F.col("t") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).alias("subtotal_sin_impuestos"),
        F.when(k % 8 > 0, F.round(F.col("s") + F.col("v"), 2)).alias("total"),
    )
    out = finance.parser_checks(totals, i)
    return out.select("doc_id", F.round("sum_items", 2).alias("sum_items"), "items_vs_subtotal", F.round("recomputed_total", 2).alias("recomputed_total"), "recomputed_vs_total")


SQL["parser_checks"] = f"""WITH {ITEMS_SQL}, g AS (SELECT doc_id, sum(precio_total) AS i, round(sum(cantidad * precio_unitario), 2) AS s, round(sum(precio_total), 2) AS t, round(sum(iva), 2) AS v FROM items GROUP BY 1),
a AS (SELECT doc_id, i, CASE WHEN doc_id % 4 = 0 THEN 1.5::DOUBLE END AS s0, CASE WHEN doc_id % 5 > 0 THEN s END AS s15, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE END AS des, CASE WHEN doc_id % 7 > 0 THEN v END AS iva,
  CASE WHEN doc_id % 6 > 0 THEN t + CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS sub, CASE WHEN doc_id % 8 > 0 THEN round(s + v, 2) END AS total FROM g),
r AS (SELECT *, CASE WHEN s0 IS NOT NULL OR s15 IS NOT NULL THEN coalesce(s0, 0) + coalesce(s15, 0) - coalesce(des, 0) + coalesce(iva, 0) END AS re FROM a)
SELECT doc_id, round(i, 2) AS sum_items, abs(i - sub) <= 0.02 AS items_vs_subtotal, round(re, 2) AS recomputed_total, abs(re - total) <= 0.02 AS recomputed_vs_total FROM r"""


def q_prefer_xml(spark, d):
    """Extracted amounts of every order, replaced by the official record where there is one."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    amounts = o.select(
        k.alias("doc_id"), F.col("o_totalprice").alias("subtotal"), F.lit(1.0).alias("iva"), F.lit(2.0).alias("descuentos"), F.lit(3.0).alias("retenciones"), F.lit(4.0).alias("propina"), (F.col("o_totalprice") + 1).alias("total_declarado")
    )
    official = finance.xml_amounts(read_invoice_xml(invoice_xml(spark, d))).withColumn("doc_id", F.col("doc_id").cast("bigint")).where(F.col("doc_id") % 3 != 1)
    return finance.prefer_xml(amounts, official.withColumn("iva", F.round("iva", 2)))


SQL["prefer_xml"] = f"""WITH {ITEMS_SQL}, x AS (SELECT doc_id, round(coalesce(sum(iva) FILTER (item_no % 2 = 0), 0), 2) AS v FROM items WHERE doc_id % 3 <> 1 GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN v IS NULL THEN o_totalprice ELSE 100.5::DOUBLE END AS subtotal, CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE v END AS iva, CASE WHEN v IS NULL THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS descuentos,
  CASE WHEN v IS NULL THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS retenciones, CASE WHEN v IS NULL THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS propina,
  CASE WHEN v IS NULL THEN o_totalprice + 1 WHEN o_orderkey % 2 = 0 THEN 1234.5::DOUBLE ELSE 0.0::DOUBLE END AS total_declarado,
  CASE WHEN v IS NULL THEN 'lineas_con_ventana' ELSE 'xml_sri_oficial' END AS metodo_usado FROM orders LEFT JOIN x ON x.doc_id = o_orderkey"""


def q_fallback_totals(spark, d):
    """Amounts of orders whose text gives little, by what the context, the lines, the last lines, the fields or the largest amounts say."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").cast("double").alias("p"))
    k, p = F.col("doc_id"), F.col("p")
    some = lambda m, v: F.when(k % m == 0, v)
    context = o.where(k % 4 > 0).select("doc_id", some(2, p).alias("subtotal"), some(3, p * 0.125).alias("iva"), some(5, p * 1.125).alias("total"))
    inferred = o.where(k % 3 > 0).select("doc_id", some(7, p + 0.03).alias("subtotal"), some(4, p * 0.125).alias("iva"), some(9, p * 1.25).alias("total"))
    tail = o.select("doc_id", some(6, p + 7).alias("total"))
    stats = o.select("doc_id", p.alias("total"), some(11, p * 0.875).alias("subtotal"), some(11, p * 0.125).alias("iva"))
    fields = o.select("doc_id", some(13, p + 1).alias("total"), some(17, p).alias("subtotal"))
    out = finance.fallback_totals(context, inferred, tail, stats, fields)
    return out.select("doc_id", *[F.round(c, 2).alias(c) for c in ("subtotal", "iva", "total")], "metodo")


_S = lambda m, v, guard="true": f"CASE WHEN {guard} AND o_orderkey % {m} = 0 THEN {v} END"
_C, _I = "o_orderkey % 4 > 0", "o_orderkey % 3 > 0"
_MERGED = ", ".join(f"CASE WHEN c_{n} IS NULL OR abs(c_{n} - i_{n}) <= 0.05 THEN coalesce(i_{n}, c_{n}) ELSE c_{n} END AS m_{n}" for n in ("s", "i", "t"))
SQL["fallback_totals"] = f"""WITH o AS (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders), a AS (SELECT o_orderkey AS doc_id, o_totalprice AS p,
  {_S(2, "o_totalprice", _C)} AS c_s, {_S(3, "o_totalprice * 0.125::DOUBLE", _C)} AS c_i, {_S(5, "o_totalprice * 1.125::DOUBLE", _C)} AS c_t,
  {_S(7, "o_totalprice + 0.03::DOUBLE", _I)} AS i_s, {_S(4, "o_totalprice * 0.125::DOUBLE", _I)} AS i_i, {_S(9, "o_totalprice * 1.25::DOUBLE", _I)} AS i_t, {_S(6, "o_totalprice + 7")} AS l_t,
  {_S(11, "o_totalprice * 0.875::DOUBLE")} AS s_s, {_S(11, "o_totalprice * 0.125::DOUBLE")} AS s_i, {_S(13, "o_totalprice + 1")} AS f_t, {_S(17, "o_totalprice")} AS f_s FROM o),
m AS (SELECT *, {_MERGED} FROM a), t AS (SELECT *, nullif(m_s, 0) AS s, nullif(m_i, 0) AS i, coalesce(nullif(m_t, 0), l_t) AS t0 FROM m), n AS (SELECT *, nullif(t0, 0) AS t FROM t),
c AS (SELECT *, CASE WHEN t IS NOT NULL AND i IS NOT NULL AND s IS NULL AND t - i > 0 THEN round(t - i, 2) ELSE m_s END AS r_s,
  CASE WHEN t IS NOT NULL AND s IS NOT NULL AND i IS NULL AND t - s BETWEEN 0 AND s * 0.20::DOUBLE THEN round(t - s, 2) ELSE m_i END AS r_i,
  CASE WHEN s IS NOT NULL AND i IS NOT NULL AND t IS NULL THEN round(s + i, 2) ELSE t0 END AS r_t FROM n),
z AS (SELECT *, coalesce(r_s, r_i, r_t) IS NOT NULL AS found, coalesce(f_t, f_s) IS NOT NULL AS named FROM c),
w AS (SELECT *, CASE WHEN named THEN f_t ELSE p END AS lt, CASE WHEN named THEN f_s ELSE s_s END AS ls, CASE WHEN named THEN NULL ELSE s_i END AS li FROM z),
v AS (SELECT *, lt / 1.15::DOUBLE AS sp, nullif(lt, 0) IS NOT NULL AND nullif(ls, 0) IS NULL AS needs FROM w)
SELECT doc_id, round(CASE WHEN found THEN r_s WHEN needs AND abs(sp - round(sp, 2)) < 0.01 THEN round(sp, 2) WHEN needs THEN lt ELSE ls END, 2) AS subtotal,
  round(CASE WHEN found THEN r_i WHEN needs AND abs(sp - round(sp, 2)) < 0.01 THEN round(lt - sp, 2) WHEN needs THEN 0 ELSE li END, 2) AS iva,
  round(CASE WHEN found THEN r_t ELSE lt END, 2) AS total, CASE WHEN found THEN 'contexto' WHEN coalesce(lt, ls) IS NOT NULL THEN 'ultimo_recurso' END AS metodo FROM v"""


# ---------------------------------------------------------------- identifiers and metadata


def q_xml_fiscal_ids(spark, d):
    k = F.col("doc_id")
    ruc = F.substring("clave", 11, 13)
    key = F.when(k % 3 == 0, F.concat(F.lit('<factura id="'), F.col("clave"), F.lit('">'))).when(k % 3 == 1, F.concat(F.lit("<factura><claveAcceso> "), F.col("clave"), F.lit("</claveAcceso>"))).otherwise(F.lit("<factura version='1'>"))
    xml = F.concat(key, F.lit("<ruc>"), ruc, F.lit("</ruc><fechaEmision>2024-01-05T10:00:00</fechaEmision></factura>"))
    docs = access_keys(spark, d).select(k.cast("string").alias("clave"), xml.alias("xml"))
    found = extract.xml_fiscal_ids(docs).join(extract.access_key_xml(docs), "clave")
    return found.select(F.col("clave").cast("bigint").alias("doc_id"), "ruc_emisor", "clave_acceso", "fecha_emision", "es_documento_sri", "clave_xml")


SQL["xml_fiscal_ids"] = f"""WITH {KEYS_SQL} SELECT doc_id, substr(clave, 11, 13) AS ruc_emisor, CASE WHEN doc_id % 3 < 2 THEN clave END AS clave_acceso, '2024-01-05T10:00:00' AS fecha_emision,
  doc_id % 3 < 2 AS es_documento_sri, CASE WHEN doc_id % 3 < 2 THEN clave END AS clave_xml FROM keys"""


def q_xmp_fields(spark, d):
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    packet = F.concat(
        F.lit("<x:xmpmeta a='b'><xmp:CreateDate> "), day, F.lit("</xmp:CreateDate>"), F.when(k % 2 == 0, F.lit('<rdf tiff:DateTime="2020:01:02 03:04:05"/>')).otherwise(F.lit("")), F.lit("<xmp:CreatorTool>T"), F.col("o_custkey"), F.lit("</xmp:CreatorTool></x:xmpmeta>")
    )
    docs = o.select(k.alias("doc_id"), F.encode(F.concat(F.lit("%PDF "), F.when(k % 5 > 0, packet).otherwise(F.lit("none"))), "UTF-8").alias("content"))
    x = extract.xmp_fields(docs)
    return x.select("doc_id", "xmp_present", *[F.col("xmp").getItem(n).alias(n) for n in ("xmp_CreateDate", "tiff_DateTime", "CreatorTool", "xmp_ModifyDate")])


SQL["xmp_fields"] = """SELECT o_orderkey AS doc_id, o_orderkey % 5 > 0 AS xmp_present, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "xmp_CreateDate",
  CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 THEN '2020:01:02 03:04:05' END AS "tiff_DateTime", CASE WHEN o_orderkey % 5 > 0 THEN 'T' || o_custkey END AS "CreatorTool", NULL::VARCHAR AS "xmp_ModifyDate" FROM orders"""


def q_image_dates(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    exif = F.create_map(F.lit("DateTimeOriginal"), F.date_format("o_orderdate", "yyyy:MM:dd 10:20:30"), F.lit("DateTime"), F.when(k % 3 == 0, F.lit("no date")).otherwise(F.lit("2021:05:06 07:08:09")))
    xmp = F.create_map(F.lit("CreateDate"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")).otherwise(F.lit("")))
    meta = o.select(k.alias("image_id"), exif.alias("exif"), xmp.alias("xmp"))
    return images.image_dates(meta).select("image_id", "campo", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


SQL["image_dates"] = """SELECT o_orderkey AS image_id, 'exif_DateTimeOriginal' AS campo, strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' AS ts FROM orders
UNION ALL SELECT o_orderkey, 'exif_DateTime', '2021-05-06 07:08:09' FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'CreateDate', strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' FROM orders WHERE o_orderkey % 2 = 0"""


def q_cert_ok(spark, d):
    """Certificates valid from the order date for a year; some without window or name."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    date = lambda c: F.when(k % 3 > 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit(""))
    rows = o.select(
        k.alias("doc_id"), date(F.col("o_orderdate").cast("timestamp_ntz")).alias("not_before"), F.when(k % 11 == 0, F.lit("soon")).otherwise(date(F.date_add("o_orderdate", 365).cast("timestamp_ntz"))).alias("not_after"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("")).otherwise(F.lit("CN=x")).alias("subject"),
    )
    return signatures.cert_ok(rows, "1996-01-01 00:00:00").select("doc_id", "valido")


SQL["cert_ok"] = """SELECT o_orderkey AS doc_id, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND (o_orderkey % 3 = 0 OR (o_orderkey % 11 > 0 AND CAST(o_orderdate AS DATE) <= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) + 365 >= DATE '1996-01-01')) AS valido FROM orders"""


# ---------------------------------------------------------------- images


def q_hash_variants(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    return images.hash_variants(e.select(k.alias("image_id"), *[F.lower(F.hex(v)).alias(n) for n, v in {"phash": k * 2654435761, "phash_rotado": F.col("user_id") * 40503 + k, "phash_escalado": k * 2654435761 + F.col("user_id")}.items()]))


SQL["hash_variants"] = """WITH h AS (SELECT event_id AS image_id, bit_count(xor(event_id * 2654435761, user_id * 40503 + event_id))::INT AS rotacion, bit_count(xor(event_id * 2654435761, event_id * 2654435761 + user_id))::INT AS escala FROM events)
SELECT *, rotacion > 15 AS sensible_rotacion, escala > 15 AS sensible_escala FROM h"""


def q_screenshot(spark, d):
    k, v = F.col("event_id"), F.col("value")
    side = lambda m: F.get(F.array(*[F.lit(x) for x in (900, 1080, 1200, 1600, 777)]), (k % m).cast("int"))
    s = table(spark, d, "events").select(
        k.alias("image_id"), side(5).alias("width"), side(4).alias("height"), (v / 100).alias("densidad_lineas"), (k % 3 == 0).alias("exif_vacio"), (k % 9).alias("cajas"), (k % 2 == 0).alias("uniforme"), (k % 7 > 0).alias("brilla"),
        (k % 11 > 4).alias("puro"), (k % 13 > 6).alias("gradiente"), (k % 17 > 8).alias("patron"),
    )
    return images.screenshot(s)


SQL["screenshot"] = """WITH e AS (SELECT event_id AS k, value / 100 AS v FROM events), s AS (SELECT k, v, k % 5 < 4 AND k % 4 IN (0, 2, 3) AND v > 0.2 AND k % 3 = 0 AND k % 9 > 5 AS shot,
  k % 2 = 0 AND k % 7 > 0 AND (k % 11 > 4 OR k % 13 > 6) AS coherent, k % 17 > 8 AS pat FROM e), f AS (SELECT *, CASE WHEN shot THEN coherent ELSE coherent OR (v > 0.15 AND pat) END AS found FROM s)
SELECT k AS image_id, shot AS es_captura, found AS tiene_texto_sintetico, CASE WHEN found AND shot THEN 'MEDIO' WHEN found THEN 'ALTO' ELSE 'BAJO' END AS nivel FROM f"""


def q_confidence_consolidated(spark, d):
    k, v = F.col("event_id"), F.col("value")
    s = table(spark, d, "events").select(
        k.alias("image_id"), F.get(F.array(F.lit(0), F.lit(1), F.lit(3)), (k % 3).cast("int")).alias("software"), F.get(F.array(F.lit(0), F.lit(1), F.lit(3)), (k % 7 % 3).cast("int")).alias("fechas"), (k % 2 == 0).alias("app"), (k % 5 == 0).alias("splicing"),
        (k % 4).alias("cortes"), (k % 6 == 0).alias("sintetico"), (k % 8 == 0).alias("captura"), (v / 100).alias("densidad_lineas"), (k % 9 == 0).alias("trazo_uniforme"), F.when(k % 10 < 3, "ALTO").when(k % 10 < 6, "MEDIO").alias("ela"),
        (k % 11 > 5).alias("ruido"), (k % 13 > 5).alias("halo"), (k % 3).alias("hashes"), (k % 5 - 1).alias("overlays"),
    )
    return images.confidence_consolidated(s)


SQL["confidence_consolidated"] = """WITH e AS (SELECT event_id AS k, value / 100 AS v, event_id % 5 = 0 OR event_id % 6 = 0 AS sp FROM events),
p AS (SELECT k, [0, 1, 3][k % 3 + 1] + [0, 1, 3][k % 7 % 3 + 1] + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 4 WHEN k % 4 > 2 THEN 2 ELSE 0 END
  + CASE WHEN k % 6 = 0 THEN CASE WHEN k % 8 = 0 THEN 2 ELSE 5 END WHEN v > 0.15 OR k % 9 = 0 THEN CASE WHEN k % 8 = 0 THEN 0 ELSE 2 END ELSE 0 END
  + CASE WHEN k % 10 < 3 THEN 3 WHEN k % 10 < 6 AND sp THEN 2 ELSE 0 END + CASE WHEN k % 11 > 5 AND sp THEN 2 ELSE 0 END + CASE WHEN k % 13 > 5 AND sp THEN 2 ELSE 0 END + k % 3
  + CASE WHEN k % 5 - 1 > 0 THEN least(5, k % 5 + 1) ELSE 0 END AS puntos FROM e)
SELECT k AS image_id, puntos, round(puntos / 33.0::DOUBLE * 100, 1) AS porcentaje, CASE WHEN k % 8 = 0 AND puntos / 33.0::DOUBLE * 100 < 30 THEN 'BAJO' WHEN puntos / 33.0::DOUBLE * 100 > 70 THEN 'ALTO' WHEN puntos / 33.0::DOUBLE * 100 > 40 THEN 'MEDIO' ELSE 'BAJO' END AS grado FROM p"""


def q_diff_level(spark, d):
    e = table(spark, d, "events")
    out = tiles.diff_level(e.select(F.col("event_id").alias("image_id"), (F.col("value") / 128).alias("sobre_3s"), ((F.col("event_id") % 40) / 128).alias("densidad_bordes")))
    return out.withColumn("porcentaje", F.round("porcentaje", 4))


SQL["diff_level"] = """WITH s AS (SELECT event_id AS image_id, value / 128 * 100 AS p, event_id % 40 / 128 AS e FROM events)
SELECT image_id, round(p, 4) AS porcentaje, (p > 8 AND e > 0.12) OR p > 15 OR e > 0.13 AS tiene_ediciones,
  CASE WHEN p > 25 OR e > 0.25 THEN 'ALTO' WHEN p > 15 OR e > 0.18 THEN 'MEDIO' WHEN p > 8 OR e > 0.13 THEN 'BAJO' ELSE 'NORMAL' END AS nivel FROM s"""


def q_ocg_confidence_steps(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return n.select("doc_id", F.round(layers.ocg_confidence_steps(F.col("n")), 6).alias("confianza"))


SQL["ocg_confidence_steps"] = """WITH g AS (SELECT l_orderkey AS doc_id, count(*) - 1 AS n FROM lineitem GROUP BY 1)
SELECT doc_id, round(CASE WHEN n >= 5 THEN least(0.95::DOUBLE, 0.6::DOUBLE + n * 0.05::DOUBLE) WHEN n >= 2 THEN 0.4::DOUBLE + n * 0.1::DOUBLE WHEN n = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confianza FROM g"""


def q_weight_totals(spark, d):
    """The weight table, each weight multiplied by the size of the parts that stand for it."""
    sizes = table(spark, d, "part").groupBy((F.col("p_partkey") % len(DEFAULT_WEIGHTS)).cast("int").alias("_k")).agg(F.max("p_size").alias("s"))
    keys = F.array(*[F.lit(k) for k in DEFAULT_WEIGHTS])
    w = default_weights(spark).join(sizes.select(F.get(keys, F.col("_k")).alias("check_key"), "s"), "check_key").withColumn("weight", F.col("weight") * F.col("s"))
    return config_tables.weight_totals(w)


_ROWS = ", ".join(f"({i}, {w})" for i, w in enumerate(DEFAULT_WEIGHTS.values()))
SQL["weight_totals"] = f"""WITH w(i, w) AS (VALUES {_ROWS}), p AS (SELECT p_partkey % {len(DEFAULT_WEIGHTS)} AS i, max(p_size) AS s FROM part GROUP BY 1), x AS (SELECT w * s AS w FROM w JOIN p USING (i))
SELECT count(*) AS total_criterios, max(w) FILTER (w > 0) AS peso_maximo_positivo, coalesce(min(w) FILTER (w < 0), 0) AS peso_maximo_negativo FROM x"""

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
