"""Inputs for the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.skew import at_least_parallel


#: order lines of one task; their columns are cheap and mostly go into a shuffle
LINE_ROWS = 5_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c):
    return F.floor(c * 100) / 100


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as invoice items; every seventh part reports five cents too much."""
    base = F.col("l_extendedprice") - F.col("descuento")
    iva = _cents(base * F.col("l_tax"))
    return (
        at_least_parallel(table(spark, sf_dir, "lineitem"), rows=LINE_ROWS)
        .withColumn("descuento", _cents(F.col("l_extendedprice") * F.col("l_discount")))
        .select(
            F.col("l_orderkey").alias("doc_id"),
            F.lit("pdf").alias("source"),
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("item_no"),
            F.concat(F.lit("ARTICULO "), F.col("l_partkey").cast("string")).alias("descripcion"),
            F.col("l_quantity").alias("cantidad"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"),
            "descuento",
            (base + iva + F.when(F.col("l_partkey") % 7 == 0, 0.05).otherwise(0.0)).alias("precio_total"),
            iva.alias("iva"),
            (F.col("l_tax") * 100).alias("tarifa"),
        )
    )


ITEMS_SQL = """items AS (
  SELECT l_orderkey AS doc_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS item_no,
         'ARTICULO ' || CAST(l_partkey AS VARCHAR) AS descripcion, l_quantity AS cantidad,
         l_extendedprice / l_quantity AS precio_unitario, descuento, l_tax * 100 AS tarifa,
         floor((l_extendedprice - descuento) * l_tax * 100) / 100 AS iva,
         (l_extendedprice - descuento) + floor((l_extendedprice - descuento) * l_tax * 100) / 100
           + CASE WHEN l_partkey % 7 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS precio_total
  FROM (SELECT *, floor(l_extendedprice * l_discount * 100) / 100 AS descuento FROM lineitem)
)"""


def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared amounts per order: the sums of its lines plus an offset fixed by the key."""
    sums = (
        invoice_items(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.sum(F.col("cantidad") * F.col("precio_unitario") - F.col("descuento")).alias("_b"), F.sum("iva").alias("_i"))
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    b, i = F.coalesce("_b", F.lit(0.0)), F.coalesce("_i", F.lit(0.0))
    mode = F.col("doc_id") % 5
    offset = (
        F.when(mode == 0, 0.0).when(mode == 1, 0.01).when(mode == 2, 0.05).when(mode == 3, 1.0).otherwise((b + i) * 0.0021737)
    )
    return orders.join(sums, "doc_id", "left").select(
        "doc_id",
        "o_orderdate",
        b.alias("subtotal"),
        i.alias("iva"),
        F.lit(0.0).alias("descuentos"),
        F.lit(0.0).alias("retenciones"),
        F.lit(0.0).alias("propina"),
        (b + i + offset).alias("total_declarado"),
    )


TOTALS_SQL = """totals AS (
  SELECT o_orderkey AS doc_id, b AS subtotal, i AS iva,
         b + i + CASE o_orderkey % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.01::DOUBLE WHEN 2 THEN 0.05::DOUBLE
                                     WHEN 3 THEN 1.0::DOUBLE ELSE (b + i) * 0.0021737::DOUBLE END AS total_declarado
  FROM (SELECT o_orderkey, coalesce(sb, 0.0::DOUBLE) AS b, coalesce(si, 0.0::DOUBLE) AS i
        FROM orders LEFT JOIN (SELECT doc_id, sum(cantidad * precio_unitario - descuento) AS sb, sum(iva) AS si
                               FROM items GROUP BY doc_id) ON doc_id = o_orderkey)
)"""

LINES_SQL = """status AS (
  SELECT *, cantidad * precio_unitario - descuento AS base_calc,
         coalesce(abs(cantidad * precio_unitario - descuento + iva - nullif(precio_total, 0)) <= 0.02, true) AS ok
  FROM items
)"""


# ---------------------------------------------------------------- claims


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims: state by order state, the amount approved for two thirds of them."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "Aprobado").when(F.col("o_orderstatus") == "O", "En Revisión").otherwise("Rechazado")
    key = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    return o.select(
        F.concat(F.lit("CLM-"), F.substring(key, 1, 3), F.lit("-"), F.substring(key, 4, 6)).alias("id_reclamo"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha_envio"),
        F.struct(
            F.concat(F.lit("Clínica "), F.col("o_custkey").cast("string")).alias("nombre"), F.col("o_orderpriority").alias("tipo_servicio")
        ).alias("proveedor"),
        state.alias("estado"),
        F.col("o_totalprice").alias("monto_solicitado"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("monto_aprobado"),
        F.lit("$").alias("moneda"),
        F.struct(F.lit(True).alias("ver"), (state != "Aprobado").alias("subir")).alias("acciones"),
    )


CLAIMS_SQL = """claims AS (
  SELECT 'CLM-' || substr(k, 1, 3) || '-' || substr(k, 4, 6) AS id_reclamo, nombre, estado, o_totalprice AS monto_solicitado,
         CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS monto_aprobado, estado <> 'Aprobado' AS subir, o_orderkey
  FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS k, 'Clínica ' || CAST(o_custkey AS VARCHAR) AS nombre,
               CASE o_orderstatus WHEN 'F' THEN 'Aprobado' WHEN 'O' THEN 'En Revisión' ELSE 'Rechazado' END AS estado
        FROM orders)
)"""


# ---------------------------------------------------------------- invoice texts and keys


def access_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 49-digit key per order; the last digit is right for some and wrong for others."""
    o = at_least_parallel(table(spark, sf_dir, "orders"))
    return _with_key(o).select(F.col("o_orderkey").alias("doc_id"), "clave")


def _with_key(o: DataFrame) -> DataFrame:
    body = F.concat(
        F.date_format("o_orderdate", "ddMMyyyy"),
        F.lit("01"),
        F.lpad((F.col("o_custkey") * 7919 + 1700000000001).cast("string"), 13, "0"),
        F.lit("2"),
        F.lit("001002"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0"),
        F.lpad((F.col("o_orderkey") * 31 % 100000000).cast("string"), 8, "0"),
        F.lit("1"),
    )
    return o.withColumn("clave", F.concat(body, (F.col("o_orderkey") % 10).cast("string")))


KEYS_SQL = """keys AS (
  SELECT o_orderkey AS doc_id,
         strftime(o_orderdate, '%d%m%Y') || '01' || lpad(CAST(o_custkey * 7919 + 1700000000001 AS VARCHAR), 13, '0') || '2' || '001002'
         || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || lpad(CAST(o_orderkey * 31 % 100000000 AS VARCHAR), 8, '0') || '1'
         || CAST(o_orderkey % 10 AS VARCHAR) AS clave
  FROM orders
)"""
MOD11_SQL = """(SELECT CASE 11 - s % 11 WHEN 11 THEN 0 WHEN 10 THEN 1 ELSE 11 - s % 11 END
  FROM (SELECT sum(CAST(substr({k}, CAST(i AS INT), 1) AS BIGINT) * (2 + (48 - i) % 6)) AS s FROM range(1, 49) t(i)))"""


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed invoice per order: header, amounts with the value on the next line, identifiers."""
    o = _with_key(at_least_parallel(table(spark, sf_dir, "orders")))
    total = F.col("o_totalprice")
    sub = F.floor(total / 1.15 * 100) / 100
    money = lambda c: F.format_string("%.2f", c)
    k = F.col("o_orderkey")
    odd = lambda m, text: F.when(k % m == 0, F.lit(text)).otherwise(F.lit(""))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Comercial Andina "), F.col("o_custkey").cast("string")),
        F.lit("Avenida Principal"),
        F.concat(F.lit("RUC: "), F.substring("clave", 11, 13)),
        F.concat(F.lit("FACTURA No. 001-002-"), F.lpad(k.cast("string"), 9, "0")),
        F.when(k % 4 == 0, F.lit("sin clave")).otherwise(F.concat(F.lit("CLAVE DE ACCESO "), F.col("clave"))),
        F.concat(F.lit("Fecha de Emisión: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.concat(F.lit("Identificación: "), F.lpad((k * 7 + 1700000000).cast("string"), 10, "0")),
        odd(3, "PRODUCTO   REPETIDO"),
        odd(3, "PRODUCTO   REPETIDO"),
        F.lit("SUBTOTAL SIN IMPUESTOS"),
        money(sub),
        F.concat(F.lit("IVA 15%: "), money(total - sub)),
        F.when(k % 5 == 0, F.lit("FORMA DE PAGO VALOR")).otherwise(F.lit("PAGO")),
        F.lit("VALOR TOTAL"),
        F.concat(F.lit("$ "), money(total)),
    )
    return o.select(k.alias("doc_id"), F.lit("pdf").alias("source"), text.alias("text"))


TEXTS_SQL = """texts AS (
  SELECT o_orderkey AS doc_id, concat_ws(chr(10),
    'Comercial Andina ' || CAST(o_custkey AS VARCHAR), 'Avenida Principal', 'RUC: ' || substr(clave, 11, 13),
    'FACTURA No. 001-002-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'),
    CASE WHEN o_orderkey % 4 = 0 THEN 'sin clave' ELSE 'CLAVE DE ACCESO ' || clave END,
    'Fecha de Emisión: ' || strftime(o_orderdate, '%d/%m/%Y'),
    'Identificación: ' || lpad(CAST(o_orderkey * 7 + 1700000000 AS VARCHAR), 10, '0'),
    CASE WHEN o_orderkey % 3 = 0 THEN 'PRODUCTO   REPETIDO' ELSE '' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'PRODUCTO   REPETIDO' ELSE '' END,
    'SUBTOTAL SIN IMPUESTOS', printf('%.2f', sub), 'IVA 15%: ' || printf('%.2f', o_totalprice - sub),
    CASE WHEN o_orderkey % 5 = 0 THEN 'FORMA DE PAGO VALOR' ELSE 'PAGO' END, 'VALOR TOTAL', '$ ' || printf('%.2f', o_totalprice)) AS text
  FROM (SELECT *, floor(o_totalprice / 1.15::DOUBLE * 100) / 100 AS sub FROM orders JOIN keys ON doc_id = o_orderkey)
)"""


# ---------------------------------------------------------------- document bytes


def pdf_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages wrapped into PDF-like bodies whose tokens depend on the key."""
    k = F.col("page_id")
    rep = lambda text, m: F.repeat(F.lit(text), (k % m).cast("int"))
    odd = lambda m, text: F.when(k % m == 0, F.lit(text)).otherwise(F.lit(""))
    signed = F.concat(
        F.lit(" /Type/Sig /SubFilter /adbe.pkcs7.detached /Name (Ana) /Reason (Firma) /ByteRange [0 100 "),
        (k * 1000 + 200).cast("string"),
        F.lit(" 50] /Contents <0A0B>"),
    )
    body = F.concat(
        F.lit("%PDF-1."), (k % 8).cast("string"), F.lit(" "), F.col("html"),
        rep(" /Type /XObject /Subtype /Form", 5), rep(" /CA 0.5 /ca 1.0 /BM /Multiply", 3), rep(" /OCGs /OC ", 4),
        F.repeat(F.lit(" startxref 0 %%EOF"), (k % 3 + 1).cast("int")),
        odd(6, " /JavaScript"), odd(7, " /EmbeddedFiles"), odd(5, " /AcroForm"), F.when(k % 4 == 0, signed).otherwise(F.lit("")),
        odd(9, " stream\nq 1 0 0 1 cm Do gs\nendstream"),
    )
    content = F.encode(body, "UTF-8")
    return at_least_parallel(table(spark, sf_dir, "pages")).select(
        k.alias("doc_id"), F.col("url").alias("name"), content.alias("content"), F.length(content).cast("bigint").alias("size_bytes")
    )


BODIES_SQL = """bodies AS (
  SELECT page_id AS doc_id, '%PDF-1.' || CAST(page_id % 8 AS VARCHAR) || ' ' || html
    || repeat(' /Type /XObject /Subtype /Form', page_id % 5) || repeat(' /CA 0.5 /ca 1.0 /BM /Multiply', page_id % 3)
    || repeat(' /OCGs /OC ', page_id % 4) || repeat(' startxref 0 %%EOF', page_id % 3 + 1)
    || CASE WHEN page_id % 6 = 0 THEN ' /JavaScript' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN ' /EmbeddedFiles' ELSE '' END
    || CASE WHEN page_id % 5 = 0 THEN ' /AcroForm' ELSE '' END
    || CASE WHEN page_id % 4 = 0 THEN ' /Type/Sig /SubFilter /adbe.pkcs7.detached /Name (Ana) /Reason (Firma) /ByteRange [0 100 '
            || CAST(page_id * 1000 + 200 AS VARCHAR) || ' 50] /Contents <0A0B>' ELSE '' END
    || CASE WHEN page_id % 9 = 0 THEN ' stream' || chr(10) || 'q 1 0 0 1 cm Do gs' || chr(10) || 'endstream' ELSE '' END AS body
  FROM pages
)"""


# ---------------------------------------------------------------- boxes


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words on a page; several share a row and some overlap."""
    x0 = (F.col("l_partkey") % 40 * 12).cast("double")
    y0 = (F.col("l_linenumber") % 3 * 20).cast("double")
    return at_least_parallel(table(spark, sf_dir, "lineitem"), rows=LINE_ROWS).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("page"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("word_no"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("l_quantity") + 5).alias("x1"),
        (y0 + 18 + F.col("l_suppkey") % 7).cast("double").alias("y1"),
        F.format_string("%.2f", F.col("l_extendedprice")).alias("text"),
        F.col("l_returnflag").alias("flag"),
    )


WORDS_SQL = """words AS (
  SELECT l_orderkey AS doc_id, 1 AS page, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS word_no,
         CAST(l_partkey % 40 * 12 AS DOUBLE) AS x0, CAST(l_linenumber % 3 * 20 AS DOUBLE) AS y0,
         l_partkey % 40 * 12 + l_quantity + 5 AS x1, CAST(l_linenumber % 3 * 20 + 18 + l_suppkey % 7 AS DOUBLE) AS y1, l_returnflag AS flag
  FROM lineitem
)"""


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes as page blocks; returned lines count as images."""
    w = line_words(spark, sf_dir)
    return w.select("doc_id", "page", F.col("word_no").alias("block_no"), F.when(F.col("flag") == "R", 1).otherwise(0).alias("type"), "x0", "y0", "x1", "y1")


# ---------------------------------------------------------------- image tiles


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8x8 tiles of images of ten by ten tiles."""
    k = F.col("vec_id")
    px = F.transform("embedding", lambda e: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), e.cast("double") * 400 + 128))).cast("smallint"))
    return at_least_parallel(table(spark, sf_dir, "embeddings")).select(
        F.floor(k / 100).alias("image_id"), (F.floor(k / 10) % 10).cast("int").alias("ty"), (k % 10).cast("int").alias("tx"), px.alias("px")
    )


def second_plane(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("px", F.transform("px", lambda v: F.floor(v * 0.9).cast("smallint")))


TILES_SQL = """tiles AS (
  SELECT vec_id // 100 AS image_id, vec_id // 10 % 10 AS ty, vec_id % 10 AS tx,
         list_transform(embedding, lambda e: CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, CAST(e AS DOUBLE) * 400 + 128))) AS INT)) AS px
  FROM embeddings
), pix AS (SELECT image_id, ty, tx, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM tiles),
moments AS (SELECT image_id, ty, tx, avg(v) AS m, var_pop(v) AS s FROM pix GROUP BY 1, 2, 3),
diffs AS (SELECT *, abs(v - floor(v * 0.9::DOUBLE)) AS d FROM pix)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as recognised tokens of one image per order."""
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        number.alias("token_no"),
        # the text shows the leading digits of the number, which a supplier above 9,999 carries into
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("AB 1")).otherwise(F.concat(F.floor(number / 1000000).cast("string"), F.lit(".50"))).alias("text"),
        (F.col("l_quantity") * 2).alias("conf"),
        (F.col("l_partkey") % 500).cast("int").alias("left"),
        (F.col("l_suppkey") % 300).cast("int").alias("top"),
        (F.col("l_quantity") + 10).cast("int").alias("width"),
        (F.col("l_linenumber") * 5).cast("int").alias("height"),
        F.lit(800).alias("page_width"),
        F.lit(600).alias("page_height"),
    )


TOKENS_SQL = """tok AS (
  SELECT l_orderkey AS image_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS token_no, l_linenumber % 3 = 0 AS word, l_quantity * 2 AS conf,
         l_partkey % 500 AS x, l_suppkey % 300 AS y, CAST(l_quantity + 10 AS INT) AS w, l_linenumber * 5 AS h FROM lineitem
)"""
