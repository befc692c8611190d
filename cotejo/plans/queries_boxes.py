"""Registered queries on page layout and on reconciliation of items."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cotejo.operators import boxes, finance, layers, recon
from cotejo.plans.derived import ITEMS_SQL, KEYS_SQL, WORDS_SQL, access_keys, invoice_items, line_blocks, line_words, table
from cotejo.skew import tasks_for

Q, SQL = {}, {}


def q_word_overlaps(spark, d):
    return boxes.word_overlaps(line_words(spark, d)).select("doc_id", "a_word_no", "b_word_no", "solapamiento")


SQL["word_overlaps"] = f"""WITH {WORDS_SQL}
SELECT a.doc_id, a.word_no AS a_word_no, b.word_no AS b_word_no, round(least(a.x1, b.x1) - greatest(a.x0, b.x0), 2) AS solapamiento
FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.y0 = b.y0 AND a.word_no < b.word_no
WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) > 0.5 * (a.x1 - a.x0 + b.x1 - b.x0) / 2"""


def q_word_overlap_summary(spark, d):
    w = line_words(spark, d)
    return boxes.overlap_summary(w, boxes.word_overlaps(w))


SQL["word_overlap_summary"] = f"""WITH {WORDS_SQL}, o AS (
  SELECT a.doc_id, count(*) AS n FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.y0 = b.y0 AND a.word_no < b.word_no
  WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) > 0.5 * (a.x1 - a.x0 + b.x1 - b.x0) / 2 GROUP BY 1
), w AS (SELECT doc_id, count(*) AS palabras FROM words GROUP BY 1)
SELECT w.doc_id, palabras, 1 AS paginas, coalesce(n, 0) AS casos, CASE WHEN n > 0 THEN 1 ELSE 0 END AS paginas_afectadas, coalesce(n, 0) > 0 AS detectado
FROM w LEFT JOIN o USING (doc_id)"""


def q_block_overlaps(spark, d):
    return boxes.block_overlaps(line_blocks(spark, d), min_area=20.0)


SQL["block_overlaps"] = f"""WITH {WORDS_SQL}, t AS (SELECT * FROM words WHERE flag <> 'R')
SELECT a.doc_id, 1 AS page, count(*) AS solapes FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.word_no < b.word_no
WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 20 GROUP BY 1"""


def _drawings(spark, d):
    w = line_words(spark, d)
    return w.where(F.col("word_no") % 5 == 0).select("doc_id", "page", F.col("word_no").alias("draw_no"), (F.col("word_no") % 2 == 0).alias("filled"), (F.col("x0") - 2).alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + 1).alias("y1"))


def q_covering_boxes(spark, d):
    return boxes.covering_boxes(line_blocks(spark, d), _drawings(spark, d)).drop("page")


SQL["covering_boxes"] = f"""WITH {WORDS_SQL}, c AS (
  SELECT doc_id, 'image' AS kind, word_no AS no, x0, y0, x1, y1 FROM words WHERE flag = 'R'
  UNION ALL SELECT doc_id, 'shape', word_no, x0 - 2, y0 - 1, x1 + 2, y1 + 1 FROM words WHERE word_no % 10 = 0
), p AS (
  SELECT c.doc_id, kind, no, greatest(0, least(c.x1, t.x1) - greatest(c.x0, t.x0)) * greatest(0, least(c.y1, t.y1) - greatest(c.y0, t.y0)) AS i,
         (c.x1 - c.x0) * (c.y1 - c.y0) AS a, (t.x1 - t.x0) * (t.y1 - t.y0) AS b
  FROM c JOIN words t ON c.doc_id = t.doc_id AND t.flag <> 'R'
) SELECT DISTINCT doc_id, kind, no FROM p WHERE i > 0 AND i / (a + b - i) > 0.5"""


def _annots(spark, d):
    w = line_words(spark, d)
    k = F.col("word_no")
    return w.select(
        "doc_id", "page", k.alias("annot_no"), F.when(k % 3 == 0, "Square").when(k % 3 == 1, "FreeText").otherwise("Link").alias("subtype"),
        F.col("x0") + 15, F.col("y0") + 9, F.col("x1") + 15, F.col("y1") + 40, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("x")).alias("content"), (k % 4 > 0).alias("has_appearance"),
    ).toDF("doc_id", "page", "annot_no", "subtype", "x0", "y0", "x1", "y1", "content", "has_appearance")


def q_overlapping_annots(spark, d):
    return boxes.overlapping_annots(_annots(spark, d), line_blocks(spark, d)).drop("page")


SQL["overlapping_annots"] = f"""WITH {WORDS_SQL} SELECT DISTINCT a.doc_id, a.word_no AS annot_no FROM words a JOIN words t ON a.doc_id = t.doc_id AND t.flag <> 'R'
WHERE a.x0 + 15 < t.x1 AND a.x1 + 15 > t.x0 AND a.y0 + 9 < t.y1 AND a.y1 + 40 > t.y0"""


def q_suspicious_annots(spark, d):
    return layers.suspicious_annots(_annots(spark, d)).select("doc_id", "annot_no", "subtype")


_SUB = "CASE WHEN word_no % 3 = 0 THEN 'Square' WHEN word_no % 3 = 1 THEN 'FreeText' ELSE 'Link' END"
SQL["suspicious_annots"] = f"""WITH {WORDS_SQL} SELECT doc_id, word_no AS annot_no, {_SUB} AS subtype FROM words
WHERE x1 - x0 > 200 OR y1 + 31 - y0 > 50 OR (word_no % 2 = 0 AND word_no % 4 > 0 AND word_no % 3 = 0)"""


def q_annot_census(spark, d):
    return layers.annot_census(_annots(spark, d))


SQL["annot_census"] = f"""WITH {WORDS_SQL} SELECT doc_id, {_SUB} AS subtype, count(*) AS n, count(*) FILTER (word_no % 3 = 1) AS de_texto, count(*) AS con_rectangulo FROM words GROUP BY 1, 2"""


def q_structure_stats(spark, d):
    b = line_blocks(spark, d)
    pages = b.select("doc_id").distinct().withColumn("pages", F.lit(2))
    images = b.where("type = 1")
    return layers.structure_stats(b, boxes.block_overlaps(b), images, _drawings(spark, d), pages).drop("sospechosa_previa")


SQL["structure_stats"] = f"""WITH {WORDS_SQL}, t AS (SELECT * FROM words WHERE flag <> 'R'), o AS (
  SELECT a.doc_id, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.word_no < b.word_no
  WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1
), c AS (SELECT doc_id, count(*) + count(*) FILTER (flag = 'R') + count(*) FILTER (word_no % 5 = 0) AS objetos FROM words GROUP BY 1)
SELECT c.doc_id, objetos, objetos / 2 AS objetos_por_pagina, coalesce(n, 0) AS solapes, least(1.0::DOUBLE, objetos / 2 / 100 + coalesce(n, 0) / 10) AS puntaje,
       objetos / 2 > 50 OR coalesce(n, 0) > 5 AS sospechosa, coalesce(n, 0) > 2 OR objetos / 2 > 50 AS sospechosa_por_pagina FROM c LEFT JOIN o USING (doc_id)"""


def q_label_amounts(spark, d):
    """Whole prices as words, every third with thousands marks, and some words as labels for the amounts of their row."""
    w = line_words(spark, d)
    labels = F.array(*[F.lit(x) for x in ("VALOR TOTAL", "TOTAL A PAGAR", "IMPORTE TO", "VALOR T")])
    k = F.col("word_no")
    price = F.when(k % 3 == 0, F.format_number(F.col("text").cast("double"), 2)).otherwise(F.col("text"))
    return boxes.label_amounts(w.withColumn("text", F.when(k % 9 < 4, F.get(labels, (k % 9).cast("int"))).otherwise(F.concat(F.col("flag"), F.lit("-"), price))))


SQL["label_amounts"] = rf"""WITH {WORDS_SQL}, w AS (
  SELECT words.doc_id, word_no, words.x0, (y0 + y1) / 2 AS yc, word_no % 9 AS k, l_extendedprice AS v
  FROM words JOIN lineitem ON l_orderkey = doc_id AND l_partkey * 1000000 + l_suppkey * 100 + l_linenumber = word_no
), a AS (SELECT * FROM w WHERE k >= 4),
l AS (SELECT *, CASE k WHEN 0 THEN 100 WHEN 1 THEN 90 WHEN 2 THEN 80 ELSE 70 END AS p FROM w WHERE k < 4),
j AS (
  SELECT l.doc_id, l.word_no AS lno, l.p, a.v, a.x0, row_number() OVER (PARTITION BY l.doc_id, l.word_no ORDER BY a.x0 DESC, a.word_no) AS r
  FROM l JOIN a ON a.doc_id = l.doc_id AND abs(a.yc - l.yc) <= 5
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, x0, lno) AS q FROM j WHERE r = 1),
m AS (SELECT doc_id, max(v) AS mx FROM a GROUP BY 1)
SELECT d.doc_id, coalesce(b.v, mx) AS valor_total, CASE WHEN b.v IS NOT NULL THEN 'busqueda_espacial' WHEN mx IS NOT NULL THEN 'busqueda_texto_fallback' ELSE 'no_encontrado' END AS metodo
FROM (SELECT DISTINCT doc_id FROM w) d LEFT JOIN b ON b.doc_id = d.doc_id AND q = 1 LEFT JOIN m ON m.doc_id = d.doc_id"""


def q_label_amounts_in_band(spark, d):
    """The same words with returned lines as label phrases."""
    w = line_words(spark, d)
    words = w.withColumn("text", F.when(F.col("word_no") % 11 == 0, "SIN").when(F.col("word_no") % 11 == 1, "SUBSIDIO").otherwise(F.col("text")))
    labels = w.where("flag = 'R'").select("doc_id", "page", F.col("word_no").alias("label_no"), "x0", "y0", (F.col("x0") + 10).alias("x1"), "y1")
    text = w.select("doc_id").distinct().select("doc_id", F.lit("pdf").alias("source"), F.lit("VALOR TOTAL: 12,50").alias("text"))
    return boxes.label_amounts_in_band(words, labels, text)


def _spans(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("page"), F.col("event_id").alias("line_no"), F.col("event_type").alias("font"),
        (F.col("event_id") % 7).cast("double").alias("origin_x"), F.when(F.col("value") > 400, 0.5).otherwise(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"),
    )


def q_font_stats(spark, d):
    return boxes.font_stats(_spans(spark, d))


SQL["font_stats"] = "SELECT doc_id, count(*) AS fuentes, sum(n) AS spans, round(max(n) / sum(n), 3) AS dominante FROM (SELECT user_id AS doc_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"


def q_alignment(spark, d):
    a = boxes.alignment(_spans(spark, d))
    return a.select("doc_id", F.round("alineacion", 6).alias("alineacion"), F.round("rotacion", 6).alias("rotacion"), "lineas")


SQL["alignment"] = """WITH m AS (SELECT user_id AS doc_id, event_id % 3 AS page, event_id % 7 AS m, count(*) AS n FROM events GROUP BY 1, 2, 3),
t AS (SELECT doc_id, page, sum(n) FILTER (r <= 2) AS top, sum(n) AS al FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, m) AS r FROM m) GROUP BY 1, 2),
x AS (SELECT user_id AS doc_id, event_id % 3 AS page, round(avg(CASE WHEN value > 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS rot FROM events GROUP BY 1, 2)
SELECT doc_id, round(avg(round(top / al, 3)), 6) AS alineacion, round(avg(rot), 6) AS rotacion, sum(al) AS lineas FROM t JOIN x USING (doc_id, page) GROUP BY 1"""


def _images(spark, d):
    li = table(spark, d, "lineitem")
    x = F.col("l_partkey") % 100
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Im"), F.col("l_linenumber")).alias("name"), (F.col("l_partkey") % 900 + 30).cast("int").alias("w_px"), (F.col("l_suppkey") * 9 + 40).cast("int").alias("h_px"),
        x.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (x + F.col("l_quantity") * 7.137 + 10.013).alias("x1"), (F.col("l_quantity") * 5.071 + 20.019).alias("y1"),
        F.when(F.col("l_linenumber") % 3 == 0, "DCTDecode, Otro").when(F.col("l_linenumber") % 3 == 1, "FlateDecode").otherwise("Raro LZWDecode").alias("filters"),
        F.col("l_partkey").alias("n_bytes"), (F.col("l_quantity") * 2).alias("variance"), (F.col("l_discount")).alias("border_share"),
    )


_IMAGES = """im AS (SELECT l_orderkey AS doc_id, l_partkey % 900 + 30 AS w_px, l_suppkey * 9 + 40 AS h_px, CAST(l_partkey % 100 + l_quantity * 7.137::DOUBLE + 10.013::DOUBLE AS DOUBLE) - CAST(l_partkey % 100 AS DOUBLE) AS dx, l_quantity * 5.071::DOUBLE + 20.019::DOUBLE AS dy, l_linenumber % 3 AS f, l_partkey AS n_bytes, l_quantity * 2 AS variance, l_discount AS border_share FROM lineitem)"""


def q_dpi_stats(spark, d):
    return boxes.dpi_stats(_images(spark, d)).select("doc_id", "imagenes", "dpi_min", "dpi_max")


SQL["dpi_stats"] = f"""WITH {_IMAGES}, p AS (SELECT doc_id, (w_px * 72.0::DOUBLE / dx + h_px * 72.0::DOUBLE / dy) / 2 AS v FROM im)
SELECT doc_id, count(*) AS imagenes, round(min(v), 1) AS dpi_min, round(max(v), 1) AS dpi_max FROM p GROUP BY 1"""


def q_unknown_filters(spark, d):
    return boxes.unknown_filters(_images(spark, d))


SQL["unknown_filters"] = f"WITH {_IMAGES} SELECT DISTINCT doc_id, CASE f WHEN 0 THEN 'Otro' ELSE 'Raro' END AS filtro FROM im WHERE f <> 1"


def q_patch_stats(spark, d):
    return layers.patch_stats(_images(spark, d))


SQL["patch_stats"] = f"""WITH {_IMAGES}, s AS (SELECT doc_id, count(*) AS imagenes, count(*) FILTER (w_px < 50 OR h_px < 50 OR variance < 10 OR border_share > 0.1) AS parches, sum(n_bytes) AS bytes,
  count(*) FILTER (w_px < 50 OR h_px < 50) AS pequenas, count(*) FILTER (variance < 10) AS uniformes FROM im GROUP BY 1)
SELECT *, round(parches / imagenes, 3) AS probabilidad, CASE WHEN parches / imagenes >= 0.5 THEN 'HIGH' WHEN parches / imagenes >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS nivel FROM s"""


def q_patch_images(spark, d):
    return layers.patch_images(_images(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


SQL["patch_images"] = f"WITH {_IMAGES} SELECT doc_id, count(*) AS n FROM im WHERE w_px < 50 OR h_px < 50 OR variance < 10 OR border_share > 0.1 GROUP BY 1"


def q_merge_boxes(spark, d):
    """Greedy merge over the boxes of each order."""
    w = line_words(spark, d).select(F.col("doc_id").alias("image_id"), F.col("word_no").alias("box_no"), *boxes.BOX)
    return boxes.merge_boxes(w, in_pieces=True).select("image_id", "box_no")


SQL["merge_boxes"] = f"""WITH RECURSIVE {WORDS_SQL}, b AS (SELECT doc_id AS image_id, word_no AS box_no, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM words GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y0 + x0 * 0.1::DOUBLE, box_no) AS i FROM b),
g(image_id, i, kept) AS (
  SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(n BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[] FROM s
  UNION ALL
  SELECT s.image_id, s.i, CASE WHEN len(list_filter(g.kept, lambda k: greatest(0, least(k.c, s.x1) - greatest(k.a, s.x0)) * greatest(0, least(k.d, s.y1) - greatest(k.b, s.y0))
      > 0.2::DOUBLE * ((k.c - k.a) * (k.d - k.b) + (s.x1 - s.x0) * (s.y1 - s.y0) - greatest(0, least(k.c, s.x1) - greatest(k.a, s.x0)) * greatest(0, least(k.d, s.y1) - greatest(k.b, s.y0)) + 1e-6))) > 0
    THEN g.kept ELSE list_append(g.kept, {{'n': s.box_no, 'a': s.x0, 'b': s.y0, 'c': s.x1, 'd': s.y1}}) END
  FROM g JOIN s ON s.image_id = g.image_id AND s.i = g.i + 1
), z AS (SELECT image_id, arg_max(kept, i) AS kept FROM g GROUP BY 1)
SELECT image_id, k.n AS box_no FROM (SELECT image_id, unnest(kept) AS k FROM z)"""


# ---------------------------------------------------------------- reconciliation


def _headers(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    base = o.select(
        k.cast("string").alias("clave"), F.lpad(k.cast("string"), 13, "1").alias("ruc"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fechaEmision"),
        F.col("o_totalprice").alias("importeTotal"), F.col("c_name").alias("razonSocial"), F.concat(F.lit("K"), k).alias("claveAcceso"), k.alias("_k"),
    )
    k = F.col("_k")
    pdf = base.where(k % 11 > 0).select(
        "clave",
        F.when(k % 7 == 0, F.lit("9")).when(k % 7 == 1, F.lit(None)).otherwise(F.col("ruc")).alias("ruc"),
        F.replace("fechaEmision", F.lit("/"), F.lit("-")).alias("fechaEmision"),
        (F.col("importeTotal") + F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("importeTotal"),
        F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower("razonSocial"))).when(k % 13 == 0, F.lit("Otro")).otherwise(F.col("razonSocial")).alias("razonSocial"),
        "claveAcceso",
    )
    return pdf, base


def q_header_recon(spark, d):
    pdf, sri = _headers(spark, d)
    return recon.reconcile_headers(pdf, sri.drop("_k")).select("clave", "campo")


SQL["header_recon"] = """WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 > 0)
SELECT CAST(k AS VARCHAR) AS clave, 'ruc' AS campo FROM o WHERE k % 7 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'importeTotal' FROM o WHERE k % 5 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'razonSocial' FROM o WHERE k % 3 > 0 AND k % 13 = 0"""


def _two_sides(spark, d):
    """Order lines numbered within the order; the printed side drops and edits some."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    sri = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.row_number().over(order) - 1).cast("bigint").alias("item_no"), F.col("p_name").alias("descripcion"),
        F.col("l_quantity").alias("cantidad"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"), F.col("l_extendedprice").alias("precio_total"), F.col("l_partkey").alias("_p"),
    )
    p = F.col("_p")
    pdf = sri.where(p % 9 > 0).select(
        "doc_id", "item_no", F.when(p % 4 == 0, F.concat("descripcion", F.lit(" x"))).otherwise(F.upper("descripcion")).alias("descripcion"),
        (F.col("cantidad") + F.when(p % 5 == 0, 1).otherwise(0)).alias("cantidad"), "precio_unitario", (F.col("precio_total") + F.when(p % 6 == 0, 0.5).otherwise(0.0)).alias("precio_total"),
    )
    return sri.drop("_p"), pdf


def q_item_match(spark, d):
    sri, pdf = _two_sides(spark, d)
    return recon.match_items(sri, pdf).select("doc_id", "sri_no", "pdf_no", F.round("similitud", 6).alias("similitud"))


def q_item_diffs(spark, d):
    sri, pdf = _two_sides(spark, d)
    return recon.differing(recon.settle_items(sri, pdf)).select("doc_id", "sri_no", "pdf_no", "dif_cantidad", "dif_precio_unitario", "dif_precio_total")


def q_item_recon_unmatched(spark, d):
    """Lines matched by number, so that the leftovers of either side can be checked in SQL."""
    sri, pdf = _two_sides(spark, d)
    matches = sri.select("doc_id", F.col("item_no").alias("sri_no")).join(pdf.select("doc_id", F.col("item_no").alias("sri_no")), ["doc_id", "sri_no"]).where("sri_no % 2 = 0").withColumn("pdf_no", F.col("sri_no"))
    return recon.unmatched_items(matches, sri, pdf).select("doc_id", "item_no", "match")


SQL["item_recon_unmatched"] = """WITH s AS (SELECT l_orderkey AS doc_id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS item_no FROM lineitem)
SELECT doc_id, item_no, 'no_encontrado_en_pdf' AS match FROM s WHERE NOT (item_no % 2 = 0 AND p % 9 > 0) UNION ALL SELECT doc_id, item_no, 'no_encontrado_en_sri' FROM s WHERE p % 9 > 0 AND item_no % 2 = 1"""


def _letter_sides(spark, d):
    """Order lines with sparse numbers and descriptions of one letter, so that lengths alone give the similarity of a pair.

    The printed side drops some lines, lengthens some descriptions and edits quantities and totals.
    """
    p = F.col("l_partkey")
    no = p * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    word = lambda n: F.expr(f"repeat(substr('ABCDE', cast(l_partkey % 5 + 1 as int), 1), cast({n} as int))")
    li = table(spark, d, "lineitem")
    line = lambda text, qty, total: li.select(F.col("l_orderkey").alias("doc_id"), no.alias("item_no"), text.alias("descripcion"), qty.alias("cantidad"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"), total.alias("precio_total"), p.alias("_p"))
    sri = line(word("4 + l_partkey % 7"), F.col("l_quantity"), F.col("l_extendedprice"))
    pdf = line(word("4 + l_partkey % 7 + case when l_partkey % 4 = 0 then 2 else 0 end"), F.col("l_quantity") + F.when(p % 5 == 0, 1).otherwise(0), F.col("l_extendedprice") + F.when(p % 6 == 0, 0.5).otherwise(0.0))
    return sri.drop("_p"), pdf.where(F.col("_p") % 9 > 0).drop("_p")


_LETTERS_SQL = """s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM (
    SELECT l_orderkey AS doc_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS no, l_partkey % 5 AS c, 4 + l_partkey % 7 AS n, l_quantity AS q, l_extendedprice / l_quantity AS u, l_extendedprice AS t FROM lineitem)
), p AS (
  SELECT l_orderkey AS doc_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS no, l_partkey % 5 AS c, 4 + l_partkey % 7 + CASE WHEN l_partkey % 4 = 0 THEN 2 ELSE 0 END AS n,
    l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS q, l_extendedprice / l_quantity AS u, l_extendedprice + CASE WHEN l_partkey % 6 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS t FROM lineitem WHERE l_partkey % 9 > 0
), pl AS (SELECT doc_id, list({'no': no, 'c': c, 'n': n}) AS l FROM p GROUP BY 1),
g(doc_id, i, used, sno, pno, r) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM s
  UNION ALL
  SELECT doc_id, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.no) END, sno, b.no, -b.r FROM (
    SELECT g.doc_id, s.i, g.used, s.no AS sno, list_sort(list_transform(
      list_filter(coalesce(pl.l, []), lambda x: x.c = s.c AND NOT list_contains(g.used, x.no) AND 2.0::DOUBLE * least(x.n, s.n) / (x.n + s.n) >= 0.6::DOUBLE),
      lambda x: {'r': -2.0::DOUBLE * least(x.n, s.n) / (x.n + s.n), 'no': x.no}))[1] AS b
    FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1 LEFT JOIN pl ON pl.doc_id = g.doc_id)
), m AS (SELECT doc_id, sno, pno, r FROM g WHERE pno IS NOT NULL)"""


def q_letter_match(spark, d):
    sri, pdf = _letter_sides(spark, d)
    return recon.match_items(sri, pdf).select("doc_id", "sri_no", "pdf_no", F.round("similitud", 6).alias("similitud"))


SQL["letter_match"] = f"WITH RECURSIVE {_LETTERS_SQL} SELECT doc_id, sno AS sri_no, pno AS pdf_no, round(r, 6) AS similitud FROM m"


def q_reconciliation(spark, d):
    """Header differences, matched and unmatched lines, item totals and the verdict of every order."""
    sri, pdf = _letter_sides(spark, d)
    headers_pdf, headers_sri = _headers(spark, d)
    both = sri.withColumn("source", F.lit("sri")).unionByName(pdf.withColumn("source", F.lit("pdf")))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    headers = recon.reconcile_headers(headers_pdf, headers_sri.drop("_k")).withColumn("clave", F.col("clave").cast("bigint"))
    return recon.settled_coincidence(docs, headers, recon.settle_items(sri, pdf), finance.item_total_difference(both))


SQL["reconciliation"] = f"""WITH RECURSIVE {_LETTERS_SQL},
h AS (SELECT CAST(clave AS BIGINT) AS doc_id, count(*) AS n FROM ({SQL["header_recon"]}) GROUP BY 1),
x AS (SELECT m.doc_id, count(*) AS n FROM m JOIN s ON s.doc_id = m.doc_id AND s.no = sno JOIN p ON p.doc_id = m.doc_id AND p.no = pno
  WHERE abs(s.q - p.q) > 0.001 OR abs(s.u - p.u) > 0.01 OR abs(s.t - p.t) > 0.02 GROUP BY 1),
lo AS (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id, no FROM s ANTI JOIN m ON m.doc_id = s.doc_id AND m.sno = s.no UNION ALL SELECT doc_id, no FROM p ANTI JOIN m ON m.doc_id = p.doc_id AND m.pno = p.no) GROUP BY 1),
t AS (SELECT doc_id, coalesce(abs(round(sum(a), 2) - round(sum(b), 2)) > 0.02, false) AS d FROM (SELECT doc_id, t AS a, NULL AS b FROM s UNION ALL SELECT doc_id, NULL, t FROM p) GROUP BY 1),
v AS (SELECT o_orderkey AS doc_id, coalesce(h.n, 0) AS n_campos, coalesce(x.n, 0) AS n_lineas, coalesce(lo.n, 0) AS n_sueltas, coalesce(t.d, false) AS difiere
  FROM orders LEFT JOIN h ON h.doc_id = o_orderkey LEFT JOIN x ON x.doc_id = o_orderkey LEFT JOIN lo ON lo.doc_id = o_orderkey LEFT JOIN t ON t.doc_id = o_orderkey)
SELECT *, n_campos + n_lineas + n_sueltas = 0 AND NOT difiere AS coincide FROM v"""


def q_dedupe_items(spark, d):
    """Items with repeated part and quantity collapsed to the first."""
    i = invoice_items(spark, d).withColumn("cantidad", F.floor(F.col("cantidad") / 10)).withColumn("precio_unitario", F.lit(1.0)).withColumn("precio_total", F.lit(2.0))
    i = i.withColumn("descripcion", F.concat(F.lit(" Artículo-"), (F.col("item_no") % 3).cast("string")))
    return recon.dedupe_items(i).select("doc_id", "item_no")


SQL["dedupe_items"] = f"WITH {ITEMS_SQL} SELECT doc_id, min(item_no) AS item_no FROM items GROUP BY doc_id, item_no % 3, floor(cantidad / 10)"


def q_item_total_difference(spark, d):
    i = invoice_items(spark, d)
    sri = i.where("item_no % 2 = 0").withColumn("source", F.lit("sri"))
    return finance.item_total_difference(i.unionByName(sri))


SQL["item_total_difference"] = f"""WITH {ITEMS_SQL}, g AS (SELECT doc_id, round(sum(precio_total) FILTER (item_no % 2 = 0), 2) AS total_sri, round(sum(precio_total), 2) AS total_pdf FROM items GROUP BY 1)
SELECT *, coalesce(abs(total_sri - total_pdf) > 0.02, false) AS difiere FROM g"""


def q_compare_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("clave"), F.col("o_totalprice").alias("v"))
    pdf = o.select("clave", F.when(F.col("clave") % 6 > 0, F.col("v") + F.when(F.col("clave") % 4 == 0, 2.0).otherwise(0.0)).alias("valor_pdf"))
    out = recon.compare_totals(pdf, o.select("clave", F.col("v").alias("valor_xml")))
    return out.select("clave", "valores_coinciden", F.round("diferencia", 4).alias("diferencia"))


SQL["compare_totals"] = """SELECT o_orderkey AS clave, o_orderkey % 6 > 0 AND o_orderkey % 4 > 0 AS valores_coinciden,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS diferencia FROM orders"""


def _auth(spark, d):
    """Authorization answers per order: none, refused, authorized late, lower case."""
    from cotejo.sources.invoice_xml import normalize_auth

    k = F.col("doc_id")
    keys = access_keys(spark, d)
    entry = lambda state, xml: F.struct(F.lit(state).alias("estado"), F.lit("1").alias("numeroAutorizacion"), F.lit("").alias("fechaAutorizacion"), F.lit("2").alias("ambiente"), F.lit(xml).alias("comprobante"))
    answers = F.when(k % 4 == 0, F.array(entry("AUTORIZADO", "<a/>"))).when(k % 4 == 1, F.array(entry("NO AUTORIZADO", "<n/>"))).when(k % 4 == 2, F.array(entry("RECHAZADO", "<r/>"), entry("autorizado ", "<b/>"))).otherwise(F.array(entry("", "")))
    return normalize_auth(keys.where(k % 5 > 0).select("clave", answers.alias("autorizaciones")))


def q_authorization_answers(spark, d):
    return _auth(spark, d)


SQL["authorization_answers"] = f"""WITH {KEYS_SQL} SELECT clave, doc_id % 4 IN (0, 2) AS autorizado, ['AUTORIZADO', 'NO AUTORIZADO', 'RECHAZADO', 'SIN_ESTADO'][CAST(doc_id % 4 + 1 AS INT)] AS estado,
  ['<a/>', '<n/>', '<b/>', NULL][CAST(doc_id % 4 + 1 AS INT)] AS xml, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS n_autorizaciones FROM keys WHERE doc_id % 5 > 0"""


def q_attach_auth(spark, d):
    return recon.attach_auth(access_keys(spark, d), _auth(spark, d)).select("doc_id", "sri_ok", "sri_estado")


SQL["attach_auth"] = """SELECT o_orderkey AS doc_id, o_orderkey % 5 > 0 AND o_orderkey % 4 IN (0, 2) AS sri_ok,
  CASE WHEN o_orderkey % 5 = 0 THEN 'SIN_RESPUESTA' ELSE ['AUTORIZADO', 'NO AUTORIZADO', 'RECHAZADO', 'SIN_ESTADO'][CAST(o_orderkey % 4 + 1 AS INT)] END AS sri_estado FROM orders"""


def invoice_xml(spark, d):
    """Invoice XML per order, with one item and one tax entry per line; the tasks that write and read it grow in number with the lines."""
    i = invoice_items(spark, d).repartition(max(tasks_for(table(spark, d, "lineitem"), 100_000), int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    money = lambda c: F.format_string("%.2f", c)
    item = F.concat(
        F.lit("<detalle><codigoPrincipal>"), F.col("item_no"), F.lit("</codigoPrincipal><descripcion>"), "descripcion", F.lit("</descripcion><cantidad>"), F.col("cantidad"),
        F.lit("</cantidad><precioUnitario>"), F.format_string("%.6f", "precio_unitario"), F.lit("</precioUnitario><descuento>"), money(F.col("descuento")), F.lit("</descuento><precioTotalSinImpuesto>"),
        money(F.col("precio_total") - F.col("iva")), F.lit("</precioTotalSinImpuesto><impuestos><impuesto><codigo>2</codigo><tarifa>"), F.col("tarifa"), F.lit("</tarifa><valor>"), money(F.col("iva")), F.lit("</valor></impuesto></impuestos></detalle>"),
    )
    tax = F.concat(F.lit("<totalImpuesto><codigo>"), F.when(F.col("item_no") % 2 == 0, "2").otherwise("3"), F.lit("</codigo><valor>"), money(F.col("iva")), F.lit("</valor></totalImpuesto>"))
    docs = i.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("d"), F.array_join(F.sort_array(F.collect_list(tax)), "").alias("t"))
    k = F.col("doc_id")
    xml = F.concat(
        F.lit("<factura><infoTributaria><ruc>"), F.lpad(k.cast("string"), 13, "0"), F.lit("</ruc><razonSocial> Andina &amp; Co </razonSocial></infoTributaria><infoFactura><totalSinImpuestos>100,50</totalSinImpuestos><totalConImpuestos>"), "t", F.lit("</totalConImpuestos>"),
        F.when(k % 2 == 0, F.lit("<importeTotal>1.234,50</importeTotal>")).otherwise(F.lit("")), F.lit("</infoFactura><detalles>"), "d", F.lit('</detalles><infoAdicional><campoAdicional nombre="email">a@b.c</campoAdicional></infoAdicional></factura>'),
    )
    wrapped = F.when(k % 3 == 0, F.concat(F.lit("<![CDATA["), xml, F.lit("]]>"))).otherwise(xml)
    return docs.select(k.cast("string").alias("clave"), wrapped.alias("xml"))


def q_xml_invoice(spark, d):
    """XML read back: tax sum, grand total and number of items per invoice."""
    from cotejo.sources.invoice_xml import read_invoice_xml

    inv = read_invoice_xml(invoice_xml(spark, d))
    out = inv.select("clave", "detalles", "infoAdicional", finance.vat_of_xml().alias("iva"), finance.total_of_xml().alias("valor_xml"))
    return out.select(F.col("clave").cast("bigint").alias("doc_id"), F.size("detalles").alias("items"), F.round("iva", 2).alias("iva"), F.round("valor_xml", 2).alias("valor_xml"), F.try_element_at("infoAdicional", F.lit("email")).alias("email"))


SQL["xml_invoice"] = f"""WITH {ITEMS_SQL} SELECT doc_id, count(*) AS items, round(coalesce(sum(iva) FILTER (item_no % 2 = 0), 0), 2) AS iva,
  CASE WHEN doc_id % 2 = 0 THEN 1234.5::DOUBLE ELSE round(100.5::DOUBLE + sum(iva), 2) END AS valor_xml, 'a@b.c' AS email FROM items GROUP BY 1"""


def q_xml_items(spark, d):
    from cotejo.sources.invoice_xml import read_invoice_xml, xml_items

    x = xml_items(read_invoice_xml(invoice_xml(spark, d)))
    return x.select(F.col("doc_id").cast("bigint").alias("doc_id"), "descripcion", "cantidad", "descuento", "iva")


SQL["xml_items"] = f"WITH {ITEMS_SQL} SELECT doc_id, descripcion, cantidad, descuento, iva FROM items"

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
