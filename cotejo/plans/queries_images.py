"""Registered queries on image tiles, tokens, metadata and the risk roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import boxes, graph, images, tiles as tl
from cotejo.plans import document_risk
from cotejo.plans.derived import TILES_SQL, TOKENS_SQL, embedding_tiles, second_plane, table, tokens
from cotejo.skew import at_least_parallel, exact_quantiles
from cotejo.sources.config import DEFAULT_WEIGHTS, default_levels, default_weights

Q, SQL = {}, {}


def _round(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- tiles


def q_block_outliers(spark, d):
    return _round(tl.block_outliers(embedding_tiles(spark, d), z=1.5))


def _share(col, k):
    return f"""SELECT image_id, round(avg(CASE WHEN abs({col} - mu) > {k} * sd THEN 1.0 ELSE 0.0 END), 6) AS proporcion, count(*) AS bloques,
  round(any_value(mu), 6) AS media, round(any_value(sd), 6) AS desviacion FROM (
  SELECT *, avg({col}) OVER (PARTITION BY image_id) AS mu, stddev_pop({col}) OVER (PARTITION BY image_id) AS sd FROM moments) GROUP BY 1"""


SQL["block_outliers"] = f"WITH {TILES_SQL} {_share('m', 1.5)}"


def q_variance_outliers(spark, d):
    return _round(tl.variance_outliers(embedding_tiles(spark, d)), 4)


SQL["variance_outliers"] = f"WITH {TILES_SQL} {_share('s', 2)}".replace(", 6)", ", 4)")


def q_quadrant_noise(spark, d):
    return _round(tl.quadrant_noise(embedding_tiles(spark, d), 300.0, grid=(10, 10)), 4)


SQL["quadrant_noise"] = f"""WITH {TILES_SQL}, q AS (SELECT image_id, ty >= 5 AS a, tx >= 5 AS b, var_pop(v) AS s FROM pix GROUP BY 1, 2, 3)
SELECT image_id, round(max(s) - min(s), 4) AS diferencia_maxima, max(s) - min(s) > 300 AS inconsistente FROM q GROUP BY 1"""


def _metrics(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("ty"), F.lit(0).alias("tx"), F.col("value").alias("lap_var"), (F.col("event_id") % 17).cast("double").alias("edge_density"))


def q_mad_outliers(spark, d):
    return _round(tl.mad_outliers(_metrics(spark, d)), 8).select("image_id", "ty", "z_edge_density", "outlier")


SQL["mad_outliers"] = """WITH e AS (SELECT user_id AS image_id, event_id AS ty, value AS a, CAST(event_id % 17 AS DOUBLE) AS b FROM events),
m AS (SELECT image_id, median(a) AS ma, median(b) AS mb FROM e GROUP BY 1),
n AS (SELECT e.*, ma, mb, abs(a - ma) AS da, abs(b - mb) AS db FROM e JOIN m USING (image_id)), k AS (SELECT image_id, median(da) AS ka, median(db) AS kb FROM n GROUP BY 1),
z AS (SELECT image_id, ty, CASE WHEN ka < 1e-9 THEN 0 ELSE 0.6745::DOUBLE * (a - ma) / ka END AS za, CASE WHEN kb < 1e-9 THEN 0 ELSE 0.6745::DOUBLE * (b - mb) / kb END AS zb FROM n JOIN k USING (image_id))
SELECT image_id, ty, round(zb, 8) AS z_edge_density, za > 2.5 OR zb > 2.5 AS outlier FROM z"""


def q_event_percentiles(spark, d):
    """Exact percentiles of values per event type through the bracketed ranks."""
    return _round(exact_quantiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p75": 0.75, "p95": 0.95}))


SQL["event_percentiles"] = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"


def _diff(spark, d):
    t = embedding_tiles(spark, d)
    return tl.plane_diff(t, second_plane(t))


def q_plane_diff_stats(spark, d):
    return _round(tl.plane_diff_stats(_diff(spark, d)))


SQL["plane_diff_stats"] = f"""WITH {TILES_SQL}, g AS (SELECT image_id, count(*) AS n, avg(d) AS media, stddev_pop(d) AS desviacion, max(d) AS maximo, quantile_cont(d, 0.95) AS p95, median(d) AS mediana FROM diffs GROUP BY 1),
h AS (SELECT image_id, median(abs(d - mediana)) AS mad FROM diffs JOIN g USING (image_id) GROUP BY 1),
u AS (SELECT g.*, mad, greatest(5.0::DOUBLE, least(255.0::DOUBLE, mediana + (mad + 1e-6) * 3 * 1.4826::DOUBLE)) AS thr FROM g JOIN h USING (image_id))
SELECT u.image_id, any_value(n) AS n, round(any_value(media), 6) AS media, round(any_value(desviacion), 6) AS desviacion, any_value(maximo) AS maximo, round(any_value(p95), 6) AS p95, round(any_value(mediana), 6) AS mediana,
  round(any_value(mad), 6) AS mad, round(any_value(thr), 6) AS umbral_robusto, round(count(*) FILTER (d > media + 2 * desviacion) / count(*), 6) AS sobre_2s,
  round(count(*) FILTER (d > media + 3 * desviacion) / count(*), 6) AS sobre_3s, round(count(*) FILTER (d > thr) / count(*), 6) AS sobre_robusto FROM diffs JOIN u USING (image_id) GROUP BY 1"""


def q_edge_ratio(spark, d):
    return _round(tl.edge_ratio(_diff(spark, d), embedding_tiles(spark, d)))


SQL["edge_ratio"] = f"""WITH {TILES_SQL}, t AS (SELECT image_id, quantile_cont(v, 0.75) AS q FROM pix GROUP BY 1),
g AS (SELECT image_id, avg(d) FILTER (v >= q) AS a, avg(d) FILTER (v < q) AS b FROM diffs JOIN t USING (image_id) GROUP BY 1)
SELECT image_id, round(a, 6) AS media_bordes, round(b, 6) AS media_lisa, round((b + 1e-6) / (a + 1e-6), 6) AS razon FROM g"""


def q_quality_slope(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("image_id"), (F.lit(95) - F.col("event_id") % 4 * 5).alias("q")).agg(F.max("value").alias("media"))
    return _round(tl.quality_slope(e))


SQL["quality_slope"] = """WITH e AS (SELECT user_id AS image_id, 95 - event_id % 4 * 5 AS q, max(value) AS y FROM events GROUP BY 1, 2)
SELECT image_id, round(regr_slope(y, CAST(100 - q AS DOUBLE)), 6) AS pendiente, arg_min(q, (y, q)) AS calidad_probable FROM e GROUP BY 1"""


def q_diff_ratio(spark, d):
    t = embedding_tiles(spark, d)
    return _round(tl.diff_ratio(t, t.withColumn("px", F.transform("px", lambda v: F.when(v % 3 == 0, v).otherwise((v + 1).cast("smallint"))))))


SQL["diff_ratio"] = f"WITH {TILES_SQL} SELECT image_id, round(avg(CASE WHEN v % 3 = 0 THEN 0.0 ELSE 1.0 END), 6) AS proporcion FROM pix GROUP BY 1"


def q_grey_entropy(spark, d):
    return _round(tl.grey_entropy(embedding_tiles(spark, d)))


SQL["grey_entropy"] = f"""WITH {TILES_SQL}, h AS (SELECT image_id, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY image_id) AS n FROM pix GROUP BY 1, 2)
SELECT image_id, round(-sum(c / n * log2(c / n)), 6) AS bits, round(-sum(c / n * ln(c / n)), 6) AS nats, count(*) FILTER (c / n > 0.01) AS dominantes FROM h GROUP BY 1"""


def q_gradient_shares(spark, d):
    return _round(tl.gradient_shares(embedding_tiles(spark, d), 8))


SQL["gradient_shares"] = f"""WITH {TILES_SQL}, g AS (SELECT image_id, ty * 8 + i // 8 AS y, tx * 8 + i % 8 AS x, v FROM pix),
s AS (SELECT image_id, abs(v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x)) AS dx, abs(v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y)) AS dy FROM g),
r AS (SELECT image_id, count(*) FILTER (dx > 50) / count(dx) AS dx50, count(*) FILTER (dy > 50) / count(dy) AS dy50, count(*) FILTER (dx > 30) / count(dx) AS dx30, count(*) FILTER (dy > 30) / count(dy) AS dy30 FROM s GROUP BY 1)
SELECT image_id, round(dx50, 6) AS dx50, round(dy50, 6) AS dy50, round(dx30, 6) AS dx30, round(dy30, 6) AS dy30, dx50 > 0.1 OR dy50 > 0.1 AS bordes_rectos, dx30 > 0.05 OR dy30 > 0.05 AS patron_texto FROM r"""


def _rough(t):
    """A twentieth of the tiles made rough, so that the block rule has something to find."""
    k = F.col("ty") * 10 + F.col("tx")
    return t.withColumn("px", F.when(k % 20 == 0, F.transform("px", lambda v, i: F.when(i % 2 == 0, 0).otherwise(255).cast("smallint"))).otherwise(F.col("px")))


def q_grid_discontinuity(spark, d):
    return _round(tl.grid_discontinuity(_rough(embedding_tiles(spark, d))), 4)


SQL["grid_discontinuity"] = f"""WITH {TILES_SQL}, p2 AS (SELECT image_id, ty, tx, i, CASE WHEN (ty * 10 + tx) % 20 = 0 THEN i % 2 * 255 ELSE v END AS v FROM pix),
b AS (SELECT image_id, ty, tx, var_pop(v) AS s, max(v) FILTER (i = 0) AS dc FROM p2 GROUP BY 1, 2, 3),
r AS (SELECT image_id, ty, ((lead(dc) OVER (PARTITION BY image_id, ty ORDER BY tx) - dc) % 256 + 256) % 256 AS x, tx, ((lead(dc) OVER (PARTITION BY image_id, tx ORDER BY ty) - dc) % 256 + 256) % 256 AS y FROM b),
f AS (SELECT image_id, count(*) AS n FROM (SELECT image_id, ty FROM r GROUP BY 1, 2 HAVING stddev_pop(x) > 2 * avg(x)) GROUP BY 1),
c AS (SELECT image_id, count(*) AS n FROM (SELECT image_id, tx FROM r GROUP BY 1, 2 HAVING stddev_pop(y) > 2 * avg(y)) GROUP BY 1),
m AS (SELECT *, avg(s) OVER (PARTITION BY image_id) AS ms, count(*) OVER (PARTITION BY image_id) AS nb FROM b), h AS (SELECT * FROM m WHERE s > 3 * ms),
k AS (SELECT a.image_id, avg(sqrt(pow((a.ty - z.ty) * 8, 2) + pow((a.tx - z.tx) * 8, 2))) AS dist FROM h a JOIN h z ON a.image_id = z.image_id AND a.ty * 10 + a.tx < z.ty * 10 + z.tx GROUP BY 1),
o AS (SELECT i.image_id, nb, coalesce(f.n, 0) AS cf, coalesce(c.n, 0) AS cc, coalesce(hn, 0) AS hn, dist FROM (SELECT image_id, any_value(nb) AS nb FROM m GROUP BY 1) i LEFT JOIN f USING (image_id) LEFT JOIN c USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS hn FROM h GROUP BY 1) USING (image_id) LEFT JOIN k USING (image_id))
SELECT image_id, nb AS bloques, cf AS cortes_filas, cc AS cortes_columnas, hn AS rugosos, round(hn / nb, 4) AS densidad, hn > 0 AND hn / nb < 0.1 AS localizado, round(dist, 4) AS distancia_media,
  coalesce(dist < 50, false) AS agrupado, cf + cc > 5 OR (hn > 0 AND hn / nb < 0.1 AND coalesce(dist < 50, false)) AS tiene_splicing FROM o"""


def q_double_compression(spark, d):
    return _round(tl.double_compression(embedding_tiles(spark, d)), 3)


def q_double_compression_simple(spark, d):
    return _round(tl.double_compression_simple(embedding_tiles(spark, d)), 3)


def _keypoints(spark, d):
    t = embedding_tiles(spark, d)
    k = F.col("ty") * 10 + F.col("tx")
    return t.select("image_id", k.cast("bigint").alias("kp_id"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"), F.transform("px", lambda v: (v / 16).cast("tinyint")).alias("descriptor"))


def q_copy_move(spark, d):
    meta = embedding_tiles(spark, d).select("image_id", F.lit(2000).alias("width"), F.lit(1000).alias("height")).distinct()
    return _round(tl.copy_move(_keypoints(spark, d), meta, ratio=0.97))


SQL["copy_move"] = f"""WITH {TILES_SQL}, k AS (SELECT image_id, ty * 10 + tx AS id, CAST((ty * 10 + tx) * 37 % 101 AS DOUBLE) AS x, CAST((ty * 10 + tx) * 53 % 97 AS DOUBLE) AS y, list_transform(px, lambda v: v // 16) AS ds FROM tiles),
p AS (SELECT a.image_id, a.id AS q, b.id AS t, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, list_sum(list_transform(range(1, 65), lambda j: bit_count(xor(a.ds[CAST(j AS INT)], b.ds[CAST(j AS INT)])))) AS dd FROM k a JOIN k b ON a.image_id = b.image_id AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, q ORDER BY dd, t) AS r FROM p),
g AS (SELECT DISTINCT m.image_id, least(m.q, m.t) AS a, greatest(m.q, m.t) AS b FROM r m JOIN r n ON m.image_id = n.image_id AND m.q = n.q AND m.r = 1 AND n.r = 2 WHERE m.dd < n.dd * 0.97::DOUBLE AND sqrt(pow(m.ax - m.bx, 2) + pow(m.ay - m.by, 2)) > 20),
c AS (SELECT image_id, count(*) AS puntos FROM k GROUP BY 1), h AS (SELECT c.image_id, puntos, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT image_id, count(*) AS n FROM g GROUP BY 1) USING (image_id))
SELECT image_id, puntos, n AS coincidencias, round(n / 2.0, 6) AS densidad_mpx, round(least(1.0, n / 2.0 / 200), 6) AS puntaje, round(least(1.0, n / 100.0), 6) AS puntaje_combinado FROM h"""


def q_patch_pairs(spark, d):
    p = embedding_tiles(spark, d).select("image_id", (F.col("ty") * 10 + F.col("tx")).cast("bigint").alias("patch_no"), "px")
    out = tl.patch_pairs(p, min_r=0.25)
    return out.select("image_id", "pares", F.get("ejemplos", F.lit(0))["i"].alias("i"), F.get("ejemplos", F.lit(0))["j"].alias("j"), F.size("ejemplos").alias("n"))


SQL["patch_pairs"] = f"""WITH {TILES_SQL}, u AS (SELECT image_id, ty * 10 + tx AS id, list_transform(px, lambda v: v - list_avg(px)) AS c FROM tiles),
w AS (SELECT *, sqrt(list_inner_product(c, c)) AS n FROM u), r AS (SELECT a.image_id, a.id AS i, b.id AS j, list_inner_product(a.c, b.c) / (a.n * b.n) AS r FROM w a JOIN w b ON a.image_id = b.image_id AND a.id < b.id)
SELECT image_id, count(*) AS pares, arg_min(i, (i, j)) AS i, arg_min(j, (i, j)) AS j, least(10, count(*)) AS n FROM r WHERE r > 0.25 GROUP BY 1"""


def q_regional_ssim(spark, d):
    return _round(tl.regional_ssim(embedding_tiles(spark, d)))


SQL["regional_ssim"] = f"""WITH {TILES_SQL}, t AS (SELECT image_id, ty, tx, px, m, s FROM tiles JOIN moments USING (image_id, ty, tx)),
p AS (SELECT a.image_id, a.m AS am, b.m AS bm, a.s AS va, b.s AS vb, list_inner_product(list_transform(a.px, lambda v: CAST(v AS DOUBLE)), list_transform(b.px, lambda v: CAST(v AS DOUBLE))) / 64 - a.m * b.m AS cov
  FROM t a JOIN t b ON a.image_id = b.image_id AND ((a.ty = b.ty AND a.tx + 1 = b.tx) OR (a.tx = b.tx AND a.ty + 1 = b.ty))),
v AS (SELECT image_id, ((2 * am * bm + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE)) / ((am * am + bm * bm + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)) AS s FROM p),
g AS (SELECT *, avg(s) OVER w AS mu, stddev_pop(s) OVER w AS sd FROM v WINDOW w AS (PARTITION BY image_id)),
r AS (SELECT image_id, count(*) AS n, any_value(mu) AS mu, any_value(sd) AS sd, min(s) AS mi, count(*) FILTER (s < mu - 2 * sd) / count(*) AS p FROM g GROUP BY 1)
SELECT image_id, n AS comparaciones, round(mu, 6) AS media, round(sd, 6) AS desviacion, round(mi, 6) AS minimo, round(p, 6) AS proporcion_baja, p > 0.1 AS inconsistente, CASE WHEN p > 0.2 THEN 'ALTO' WHEN p > 0.1 THEN 'MEDIO' ELSE 'BAJO' END AS nivel FROM r"""


def _flags(spark, d):
    """Every event is a flagged tile: 640 events to an image, its row by value."""
    k = F.col("event_id")
    return table(spark, d, "events").select(F.floor(k / 640).alias("image_id"), F.floor(F.col("value") / 4).cast("int").alias("ty"), (k % 64).cast("int").alias("tx"))


def q_tile_clusters(spark, d):
    return _round(graph.tile_clusters(_flags(spark, d), 4), 4)


_FLAGS = "f AS (SELECT DISTINCT event_id // 640 AS image_id, CAST(floor(value / 4) AS BIGINT) AS ty, event_id % 64 AS tx FROM events)"
SQL["tile_clusters"] = f"""WITH RECURSIVE {_FLAGS}, n AS (SELECT *, ty * 2147483648 + tx AS id FROM f), e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM n a JOIN n b ON a.image_id = b.image_id AND abs(a.ty - b.ty) + abs(a.tx - b.tx) = 1),
r(image_id, id, root) AS (SELECT image_id, id, id FROM n UNION SELECT r.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.id),
l AS (SELECT image_id, id, min(root) AS c FROM r GROUP BY 1, 2), g AS (SELECT image_id, c, count(*) AS k, min(tx) AS x0, min(ty) AS y0, max(tx) + 1 AS x1, max(ty) + 1 AS y1 FROM l JOIN n USING (image_id, id) GROUP BY 1, 2)
SELECT image_id, c AS cluster_id, k AS tiles, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, round((x1 - x0) * (y1 - y0) / (k + 1e-6), 4) AS compacidad, (x1 - x0) * (y1 - y0) / (k + 1e-6) < 6 AS localizado FROM g WHERE k >= 4"""


# ---------------------------------------------------------------- tokens


def q_filter_tokens(spark, d):
    t = tokens(spark, d)
    parts = [images.filter_tokens(t, p).select("image_id", "token_no", F.lit(p).alias("perfil")) for p in ("overlay", "numeric", "confident")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["filter_tokens"] = f"""WITH {TOKENS_SQL} SELECT image_id, token_no, 'overlay' AS perfil FROM tok WHERE conf >= 30 UNION ALL SELECT image_id, token_no, 'numeric' FROM tok WHERE conf >= 40 AND w >= 20 AND h >= 10 AND NOT word
UNION ALL SELECT image_id, token_no, 'confident' FROM tok WHERE conf >= 80 AND w >= 20 AND h >= 20"""


def q_font_size_groups(spark, d):
    t = tokens(spark, d).withColumn("height", F.col("height") + 1).withColumn("width", F.col("width") * 1.0137)
    return _round(images.font_size_groups(t)).select("image_id", "textos", "grupos", "alto_sd", "sospechoso")


SQL["font_size_groups"] = f"""WITH {TOKENS_SQL}, tk AS (SELECT image_id, w * 1.0137::DOUBLE AS w, h + 1 AS h FROM tok), g AS (SELECT image_id, count(*) AS n, avg(h) AS mh, stddev_pop(h) AS sh, stddev_pop(w / h) AS sa FROM tk GROUP BY 1),
k AS (SELECT image_id, count(DISTINCT CASE WHEN h < mh * 0.8::DOUBLE THEN 0 WHEN h > mh * 1.2::DOUBLE THEN 2 ELSE 1 END) AS grupos FROM tk JOIN g USING (image_id) GROUP BY 1)
SELECT image_id, n AS textos, grupos, round(sh, 6) AS alto_sd, n >= 2 AND (grupos > 2 OR sh > mh * 0.5 OR sa > 0.5) AS sospechoso FROM g JOIN k USING (image_id)"""


def q_top_words(spark, d):
    return images.top_words(tokens(spark, d))


SQL["top_words"] = f"""WITH {TOKENS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, token_no) AS puesto FROM tok WHERE conf >= 80 AND w >= 20 AND h >= 20),
s AS (SELECT *, conf / 100.0::DOUBLE * 0.7::DOUBLE + least(1.0::DOUBLE, w * h / (800 * 600 * 0.01::DOUBLE)) * 0.3::DOUBLE AS p FROM r WHERE puesto <= 3)
SELECT image_id, token_no, puesto, round(p, 3) AS puntaje, p >= 0.8 AS overlay FROM s"""


def q_tokens_for_boxes(spark, d):
    t = tokens(spark, d)
    b = boxes.token_boxes(t).select("image_id", F.col("token_no").alias("box_no"), (F.col("x0") + 2).alias("x0"), (F.col("y0") + 1).alias("y0"), "x1", "y1")
    return boxes.tokens_for_boxes(b, t)


SQL["tokens_for_boxes"] = f"""WITH {TOKENS_SQL}, p AS (SELECT b.image_id, b.token_no AS box_no, t.token_no, t.word, greatest(0, least(b.x + b.w, t.x + t.w) - greatest(b.x + 2, t.x)) * greatest(0, least(b.y + b.h, t.y + t.h) - greatest(b.y + 1, t.y)) AS i,
  (b.w - 2) * (b.h - 1) AS a, t.w * t.h AS c FROM tok b JOIN tok t ON b.image_id = t.image_id),
f AS (SELECT image_id, box_no, min(token_no) AS k FROM p WHERE i > 0 AND i / (a + c - i) > 0.4 GROUP BY 1, 2)
SELECT image_id, box_no, CASE WHEN k % 100 % 3 = 0 THEN 'AB 1' ELSE CAST(k // 1000000 AS VARCHAR) || '.50' END AS text, k % 100 % 3 > 0 AS es_numerico FROM f"""


def q_localized_boxes(spark, d):
    t = boxes.token_boxes(tokens(spark, d)).select("image_id", F.col("token_no").alias("box_no"), "x0", "y0", "x1", "y1")
    return boxes.localized(t)


SQL["localized_boxes"] = f"""WITH {TOKENS_SQL}, c AS (SELECT image_id, token_no, x + w / 2 AS cx, y + h / 2 AS cy FROM tok)
SELECT i.image_id, coalesce(l, false) AS localizado FROM (SELECT DISTINCT image_id FROM tok) i LEFT JOIN (SELECT DISTINCT a.image_id, true AS l FROM c a JOIN c b ON a.image_id = b.image_id AND a.token_no <> b.token_no AND pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) < 3600) USING (image_id)"""


def _stats(spark, d):
    """Measurements per token, spread by the keys of the order lines."""
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (k * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("token_no"),
        (k % 120).cast("double").alias("var"), (F.col("l_suppkey") % 40).cast("double").alias("std"), (k % 30).cast("double").alias("min"), (F.col("l_suppkey") % 80 + 180).cast("double").alias("max"),
        (F.col("l_quantity") / 100).alias("edge_share"), (F.col("l_quantity") / 10).alias("sw_mean"), ((k % 100) / 100).alias("sw_cv"), ((k % 7) / 10).alias("ela_in"), ((k % 5 + 1) / 10).alias("ela_ring"),
        ((k % 60) / 10).alias("entropy"), ((k % 90) / 100).alias("halo"), ((k % 40) / 100).alias("coherence"), (F.lit(1.0) - (k % 40) / 10).alias("z_hf"), (k % 50).cast("int").alias("dom_bins"), (k % 3 == 0).alias("colorish"),
        (k % 20).alias("n_pts"), (k % 4 > 0).alias("puro"), (F.col("l_quantity") / 40).alias("sw_std"),
    )


_STATS = """st AS (SELECT l_orderkey AS image_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS token_no, l_partkey AS k, l_suppkey AS s, l_quantity AS q FROM lineitem)"""


def q_token_overlay(spark, d):
    return images.token_overlay(_stats(spark, d)).select("image_id", "token_no", "puntos", "sospechoso")


SQL["token_overlay"] = f"""WITH {_STATS}, p AS (SELECT image_id, token_no, CASE WHEN k % 120 < 50 THEN 3 ELSE 0 END + CASE WHEN s % 80 + 180 - k % 30 > 200 AND s % 40 < 30 THEN 2 ELSE 0 END + CASE WHEN q / 100 < 0.1 THEN 2 ELSE 0 END
  + CASE WHEN s % 40 < 20 THEN 1 ELSE 0 END + CASE WHEN s % 80 + 180 - k % 30 > 250 THEN 1 ELSE 0 END AS puntos FROM st) SELECT *, puntos >= 3 AS sospechoso FROM p"""


def q_overlay_boxes(spark, d):
    return images.top_suspects(images.overlay_boxes(_stats(spark, d)), tie="token_no").select("image_id", "token_no", "puntaje", "tipo", "puesto")


SQL["overlay_boxes"] = f"""WITH {_STATS}, f AS (SELECT image_id, token_no, k % 100 <= 55 AS t, k % 90 >= 45 AS h, (k % 7 / 10) / (((k % 5) + 1) / 10) >= 1.8::DOUBLE AS e, 1.0::DOUBLE - k % 40 / 10 <= -1.5::DOUBLE AS r, k % 40 >= 22 AS c, k % 60 <= 40 AND k % 50 <= 25 AS p, k % 3 = 0 AS o FROM st),
g AS (SELECT *, t AND (h OR e) AND r AND c AS n, o AND t AND c AS l, 3 * CAST(t AS INT) + 2 * CAST(h AS INT) + 2 * CAST(e AS INT) + 2 * CAST(r AS INT) + CAST(c AS INT) + CAST(p AS INT) + 2 * CAST(o AS INT) AS puntaje FROM f),
z AS (SELECT image_id, token_no, puntaje, CASE WHEN n AND NOT l THEN 'texto_neutro' WHEN l AND NOT n THEN 'overlay_color' ELSE 'mixto' END AS tipo, row_number() OVER (PARTITION BY image_id ORDER BY puntaje DESC, token_no) AS puesto FROM g WHERE n OR l)
SELECT * FROM z WHERE puesto <= 10"""


def q_injected_numbers(spark, d):
    return images.injected_numbers(_stats(spark, d))


SQL["injected_numbers"] = f"""WITH {_STATS}, p AS (SELECT image_id, CASE WHEN k % 100 <= 55 AND q / 10 >= 1 THEN 10 ELSE 0 END + CASE WHEN (k % 7 / 10 + 1e-6) / (((k % 5) + 1) / 10 + 1e-6) >= 1.5::DOUBLE AND k % 7 / 10 >= 0.02 THEN 8 ELSE 0 END
  + CASE WHEN k % 60 <= 30 THEN 6 ELSE 0 END + CASE WHEN q / 100 >= 0.18::DOUBLE THEN 6 ELSE 0 END AS s FROM st), g AS (SELECT image_id, count(*) FILTER (s >= 14) AS n, coalesce(sum(s) FILTER (s >= 14), 0) AS t FROM p GROUP BY 1)
SELECT image_id, n AS sospechosos, least(100, t) AS puntaje, CASE WHEN t >= 25 THEN 'PRIORITARIO' WHEN t >= 14 THEN 'MEDIO' ELSE 'BAJO' END AS nivel FROM g"""


def q_synthetic_text(spark, d):
    s = _stats(spark, d).withColumn("image_id", F.col("image_id") % 400)
    return images.synthetic_text(s).select("image_id", "cajas", "tiene_texto_sintetico", "nivel", F.round("trazo_cv", 6).alias("trazo_cv"))


SQL["synthetic_text"] = f"""WITH {_STATS}, g AS (SELECT image_id % 400 AS image_id, count(*) AS n, coalesce(avg(q / 10) FILTER (k % 20 >= 10), 0) AS t, coalesce(avg(q / 40) FILTER (k % 20 >= 10), 0) AS sd, avg(CASE WHEN k % 4 > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(k % 90 / 100) AS h FROM st GROUP BY 1),
f AS (SELECT *, CASE WHEN t > 0 THEN sd / (t + 1e-6) ELSE 1.0 END AS cv FROM g), r AS (SELECT *, n >= 30 AND CAST(cv < 0.45 AND t >= 1.2 AS INT) + CAST(p >= 0.6 AS INT) + CAST(h >= 0.45 AS INT) >= 2 AS x FROM f)
SELECT image_id, n AS cajas, x AS tiene_texto_sintetico, CASE WHEN x THEN 'MEDIO' ELSE 'BAJO' END AS nivel, round(cv, 6) AS trazo_cv FROM r"""


def q_coloured_overlays(spark, d):
    k = F.col("l_partkey")
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (k % 200).alias("area"), ((k % 20) / 1000).alias("area_share"), (F.col("l_quantity") / 2).alias("aspect"), ((k % 10) / 10).alias("edge_ratio"), ((F.col("l_suppkey") % 8) / 10).alias("w_cv"),
        F.lit(0.3).alias("roi_inter"), F.lit(0.9).alias("solidity"), (k % 12).cast("double").alias("hue_var"), ((F.col("l_orderkey") % 10) / 100).alias("colour_share"),
    )
    return images.coloured_overlays(c)


SQL["coloured_overlays"] = """WITH g AS (SELECT l_orderkey AS image_id, count(*) FILTER (l_partkey % 200 >= 40 AND l_partkey % 20 <= 15 AND l_quantity / 2 BETWEEN 2 AND 20 AND l_partkey % 10 >= 6 AND l_suppkey % 8 < 5 AND l_partkey % 12 <= 8) AS n FROM lineitem GROUP BY 1),
s AS (SELECT image_id, n, greatest(0, CASE WHEN n >= 3 THEN 50 WHEN n >= 2 THEN 40 WHEN n >= 1 THEN 25 ELSE 0 END - CASE WHEN image_id % 10 > 5 THEN 20 ELSE 0 END) AS p FROM g)
SELECT image_id, n AS trazos, p AS puntaje, p >= 25 AND n >= 1 AS coincide FROM s"""


def q_line_angles(spark, d):
    li = table(spark, d, "lineitem")
    s = li.select((F.col("l_orderkey") % 500).alias("image_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_partkey") % 21 - 10).cast("double").alias("x2"), (F.col("l_suppkey") % 21 - 10.5).cast("double").alias("y2"))
    return images.line_angles(s).drop("en_clusters")


SQL["line_angles"] = """WITH s AS (SELECT l_orderkey % 500 AS image_id, degrees(atan2(CAST(l_suppkey % 21 - 10.5::DOUBLE AS DOUBLE), CAST(l_partkey % 21 - 10 AS DOUBLE))) AS a FROM lineitem),
k AS (SELECT image_id, round_even(abs(a) % 180 / 5, 0) AS k, count(*) AS c FROM s GROUP BY 1, 2), n AS (SELECT image_id, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT image_id, count(*) FILTER (c >= greatest(3, n // 10)) AS grupos, any_value(n) AS lineas FROM k JOIN n USING (image_id) GROUP BY 1),
h AS (SELECT image_id, count(*) FILTER (c > 1) AS direcciones FROM (SELECT image_id, floor((a + 180) / 10) AS b, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT image_id, a, count(*) AS c FROM s GROUP BY 1, 2),
p AS (SELECT image_id, sum(c) AS p FROM (SELECT image_id, c * (c - 1) // 2 AS c FROM u UNION ALL SELECT x.image_id, x.c * y.c FROM u x JOIN u y ON x.image_id = y.image_id AND x.a < y.a AND y.a - x.a < 5) GROUP BY 1)
SELECT image_id, grupos, lineas, direcciones, p AS pares_paralelos FROM g JOIN h USING (image_id) JOIN p USING (image_id)"""


# ---------------------------------------------------------------- metadata and hashes


def _meta(spark, d):
    """Order dates as image metadata with gaps, disorder and missing fields."""
    k = F.col("o_orderkey")
    stamp = lambda days: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), days), "yyyy:MM:dd HH:mm:ss")
    blank = lambda test, c: F.when(test, c).otherwise("")
    exif = F.create_map(
        F.lit("DateTimeOriginal"), blank(k % 4 > 0, stamp(F.lit(0))), F.lit("DateTimeDigitized"), blank(k % 4 > 1, stamp((k % 5 - 2).cast("int"))), F.lit("DateTime"), blank(k % 4 > 2, stamp((k % 3 * 400 - 1).cast("int"))),
        F.lit("Make"), blank(k % 2 == 0, F.lit("Canon")), F.lit("Model"), blank(k % 2 == 0, F.lit("X")), F.lit("Software"), F.when(k % 7 == 0, "Adobe Photoshop").when(k % 7 == 1, "WhatsApp").otherwise(""),
        F.lit("XResolution"), F.lit("72"), F.lit("YResolution"), F.when(k % 3 == 0, "96").otherwise("72"),
    )
    xmp = F.create_map(F.lit("xmp_CreateDate"), F.when(k % 5 == 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "yyyy-MM-dd")))
    return at_least_parallel(table(spark, d, "orders")).select(k.alias("image_id"), F.lit(100).alias("width"), F.lit(100).alias("height"), exif.alias("exif"), xmp.alias("xmp"))


def q_editor_hits(spark, d):
    return images.editor_hits(_meta(spark, d)).select("image_id", "editor", "grupo", "posible_app")


SQL["editor_hits"] = "SELECT o_orderkey AS image_id, o_orderkey % 7 = 0 AS editor, CASE o_orderkey % 7 WHEN 0 THEN 'photoshop' WHEN 1 THEN 'mensajeria' END AS grupo, o_orderkey % 2 = 1 AS posible_app FROM orders"


def q_pick_dates(spark, d):
    p = images.pick_dates(_meta(spark, d))
    return p.select("image_id", F.col("creacion").cast("string").alias("creacion"), F.col("modificacion").cast("string").alias("modificacion"), "fuente")


_META = """m AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), md AS (
  SELECT k, CASE WHEN k % 4 > 0 THEN d END AS o, CASE WHEN k % 4 > 1 THEN d + CAST(k % 5 - 2 AS INT) END AS g, CASE WHEN k % 4 > 2 THEN d + CAST(k % 3 * 400 - 1 AS INT) END AS c, CASE WHEN k % 5 = 0 THEN d + 2 END AS x FROM m)"""
SQL["pick_dates"] = f"""WITH {_META} SELECT k AS image_id, strftime(coalesce(o, g), '%Y-%m-%d 00:00:00') AS creacion, strftime(c, '%Y-%m-%d 00:00:00') AS modificacion, CASE WHEN o IS NOT NULL OR c IS NOT NULL THEN 'EXIF' ELSE 'No disponible' END AS fuente FROM md"""


def q_date_gaps(spark, d):
    """Gaps between the order dates of each customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return images.date_gaps(o)


SQL["date_gaps"] = """WITH u AS (SELECT DISTINCT o_custkey AS image_id, o_orderdate AS ts FROM orders), g AS (SELECT image_id, date_diff('day', lag(ts) OVER (PARTITION BY image_id ORDER BY ts), ts) AS d FROM u)
SELECT image_id, coalesce(max(d), 0) AS mayor_brecha, count(*) FILTER (d > 365) AS brechas, 8 * count(*) FILTER (d > 365) AS puntos FROM g GROUP BY 1"""


def q_date_consistency(spark, d):
    return images.date_consistency(_meta(spark, d), "2001-06-01 00:00:00")


SQL["date_consistency"] = f"""WITH {_META}, l AS (SELECT k, o, g, c, x, list_sort(list_filter([o, g, c, x], lambda v: v IS NOT NULL)) AS t FROM md),
r AS (SELECT k, len(t) AS fechas, [
  struct_pack(n := 'sin_fechas', p := CASE WHEN k % 4 = 0 THEN 15 ELSE 0 END),
  struct_pack(n := 'exif_minimo', p := CASE WHEN 2 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 7 < 2 THEN 1 ELSE 0 END <= 2 THEN 10 ELSE 0 END),
  struct_pack(n := 'sin_camara', p := CASE WHEN k % 2 = 1 AND k % 7 > 1 THEN 5 ELSE 0 END),
  struct_pack(n := 'original_tras_digital', p := CASE WHEN o > g THEN 15 ELSE 0 END), struct_pack(n := 'digital_tras_cambio', p := CASE WHEN g > c THEN 10 ELSE 0 END),
  struct_pack(n := 'futuras', p := 20 * len(list_filter(t, lambda v: v > DATE '2001-06-01'))), struct_pack(n := 'identicas', p := CASE WHEN len(list_distinct(t)) = 1 THEN 12 ELSE 0 END),
  struct_pack(n := 'brechas', p := 8 * len(list_filter(range(2, len(t) + 1), lambda i: date_diff('day', t[CAST(i - 1 AS INT)], t[CAST(i AS INT)]) > 365))),
  struct_pack(n := 'xmp_posterior', p := CASE WHEN x > greatest(o, g, c) THEN 8 ELSE 0 END), struct_pack(n := 'mensajeria', p := CASE WHEN k % 7 = 1 THEN 3 ELSE 0 END),
  struct_pack(n := 'resolucion', p := CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END), struct_pack(n := 'camara_ausente', p := CASE WHEN k % 2 = 1 AND k % 7 < 2 THEN 8 ELSE 0 END)] AS a FROM l)
SELECT k AS image_id, fechas, least(50, CAST(list_sum(list_transform(a, lambda z: z.p)) AS BIGINT)) AS puntos, array_to_string(list_transform(list_filter(a, lambda z: z.p > 0), lambda z: z.n), ',') AS reglas FROM r"""


def q_adjacent_hash(spark, d):
    """Texts' digests as block hashes, in order within each language."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("image_id"), F.col("doc_id").alias("block_no"), F.substring(F.md5("text"), 1, 16).alias("phash"))
    return _round(images.adjacent_hash(docs))


SQL["adjacent_hash"] = """WITH h AS (SELECT lang AS image_id, doc_id, CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT) AS p FROM documents), l AS (SELECT image_id, bit_count(xor(p, lag(p) OVER (PARTITION BY image_id ORDER BY doc_id))) AS d FROM h),
g AS (SELECT *, avg(d) OVER (PARTITION BY image_id) AS mu, stddev_pop(d) OVER (PARTITION BY image_id) AS sd FROM l WHERE d IS NOT NULL), r AS (SELECT image_id, count(*) AS n, any_value(mu) AS mu, any_value(sd) AS sd, max(d) AS mx, count(*) FILTER (d > mu + 2 * sd) / count(*) AS p FROM g GROUP BY 1)
SELECT image_id, n AS comparaciones, round(mu, 6) AS media, round(sd, 6) AS desviacion, mx AS maximo, round(p, 6) AS proporcion, CASE WHEN p > 0.3 THEN 'ALTO' WHEN p > 0.2 THEN 'MEDIO' ELSE 'BAJO' END AS nivel FROM r"""


# ---------------------------------------------------------------- decisions


def _orders(spark, d):
    return at_least_parallel(table(spark, d, "orders")).withColumn("k", F.col("o_orderkey"))


def q_image_risk(spark, d):
    k = F.col("k")
    flags = _orders(spark, d).select(k.alias("image_id"), (k % 3 > 0).alias("sri_verificado"), *[(k % m == 0).alias(n) for n, m in (("texto_sintetico", 2), ("ruido", 5), ("ela", 7), ("doble_compresion", 4), ("hashes", 6), ("metadatos", 9))])
    return images.image_risk(flags)


SQL["image_risk"] = """WITH s AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 18 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 12 ELSE 0 END
  + CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 0 END AS score FROM orders)
SELECT image_id, score, CASE WHEN score >= 80 THEN 'alto' WHEN score >= 50 THEN 'medio' ELSE 'bajo' END AS nivel, score >= 80 AS es_falso_probable FROM s"""


def q_image_suspicion(spark, d):
    k = F.col("k")
    s = _orders(spark, d).select(
        k.alias("image_id"), ((k % 150) / 100).alias("razon"), ((k % 30) / 100).alias("outliers"), (k % 100).cast("double").alias("p95"), ((k % 20 - 10) / 100).alias("pendiente"), ((k % 11) / 10).alias("copia"),
        (k % 5).alias("overlays"), (k % 2 == 0).alias("fuentes"), (k % 3 == 0).alias("capas_pdf"), F.when(k % 4 > 0, k % 4 > 1).alias("montos_coherentes"), (k % 7 == 0).alias("editor"), (k % 6 > 0).alias("exif"), (k % 50).alias("fechas"),
    )
    return images.image_suspicion(s).select("image_id", "sospecha", "etiqueta")


def _cl(x, lo, hi, p):
    return f"(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {lo}::DOUBLE) / {hi - lo}::DOUBLE)) * {p}::DOUBLE)"


SQL["image_suspicion"] = f"""WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 20 - 10) / 100 AS sl FROM orders), s AS (SELECT k, {_cl('k % 150 / 100', 0.6, 1.2, 25)} + {_cl('k % 30 / 100', 0.0, 0.15, 20)} + {_cl('k % 100 / 255.0::DOUBLE', 0.12, 0.28, 10)}
  + CASE WHEN sl >= 0 THEN {_cl('0.08::DOUBLE - sl', 0.0, 0.08, 8)} ELSE {_cl('abs(sl)', 0.0, 0.1, 8)} END + k % 11 / 10 * 15.0::DOUBLE + CASE WHEN k % 7 = 0 THEN 5 WHEN k % 6 > 0 THEN 0 ELSE 2 END
  + CASE WHEN k % 5 >= 3 THEN 8 WHEN k % 5 >= 1 THEN 4 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 10 ELSE 0 END + k % 50 AS t FROM o)
SELECT k AS image_id, round(least(100.0::DOUBLE, t), 2) AS sospecha, CASE WHEN t < 25 THEN 'baja' WHEN t < 50 THEN 'media' WHEN t < 75 THEN 'alta' ELSE 'muy_alta' END AS etiqueta FROM s"""


def q_noise_decision(spark, d):
    k = F.col("k")
    s = _orders(spark, d).select(k.alias("image_id"), ((k % 20) / 100).alias("outliers"), (k % 3).alias("clusters"), ((k % 9) / 10).alias("halo"), ((k % 7) / 10).alias("en_clusters"), (k % 2).alias("grupos"))
    return images.noise_decision(s)


SQL["noise_decision"] = """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 20 > 5 AND o_orderkey % 3 > 0 AS b, CASE WHEN o_orderkey % 9 >= 5 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 7 >= 4 AND o_orderkey % 2 >= 1 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 20 > 12 THEN 1 ELSE 0 END AS s FROM orders)
SELECT k AS image_id, b AS tiene_edicion_local, CASE WHEN b AND s <= 2 THEN 'MEDIO' WHEN b THEN 'ALTO' ELSE 'BAJO' END AS nivel FROM b"""


def q_focused_diff(spark, d):
    """Bright tiles of the difference plane grouped and compared with the tokens of the image."""
    t = _rough(embedding_tiles(spark, d))
    diff = tl.plane_diff(t, second_plane(second_plane(second_plane(t))))
    stats = tl.plane_diff_stats(diff)
    flagged = images.flagged_diff_tiles(diff, stats, share=0.0, peak=35.0)
    c = graph.tile_clusters(flagged, 3, 8, 8)
    named = graph.connected_tiles(flagged).join(flagged, ["image_id", "ty", "tx"]).groupBy("image_id", F.col("component").alias("cluster_id")).agg(F.avg("proporcion").alias("proporcion_media"), F.max("pico").alias("pico"))
    toks = tokens(spark, d).withColumn("image_id", F.col("image_id") % 5).withColumn("left", F.col("left") % 70).withColumn("top", F.col("top") % 70)
    return images.focused_diff(c.join(named, ["image_id", "cluster_id"]), boxes.clusters_on_text(c, toks), peak=35.0)


def q_flattened_policy(spark, d):
    k = F.col("k")
    s = _orders(spark, d).select(
        k.alias("image_id"), (k % 5 == 0).alias("sintetico"), (k % 60).alias("cajas"), F.lit(2.0).alias("trazo"), ((k % 20) / 10).alias("trazo_sd"), (k % 3 == 0).alias("puro"), ((k % 8) / 10).alias("halo"), ((k % 11) / 100).alias("outliers"),
        (k % 7 == 0).alias("localizado"), (k % 9 == 0).alias("agrupado"), ((k % 25) / 100).alias("densidad"), (k % 13).cast("double").alias("ela_region"), (k % 10).cast("double").alias("ela_global"), (k % 2 == 0).alias("montos"), (k % 4 == 0).alias("captura"), (k % 6 * 50).alias("dpi"),
    )
    return images.flattened_policy(s)


SQL["flattened_policy"] = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS c, o_orderkey % 6 IN (1, 2) AS l FROM orders), f AS (SELECT k,
  k % 5 = 0 OR (k % 60 >= 30 AND k % 20 / 10 / 2.0::DOUBLE <= 0.55::DOUBLE) OR (k % 60 >= 30 AND k % 3 = 0) AS t,
  k % 8 / 10 >= 0.45::DOUBLE + CASE WHEN c THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN l THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AND k % 11 / 100 > CASE WHEN c THEN 0.05::DOUBLE + 0.01::DOUBLE ELSE 0.05::DOUBLE END AS n,
  k % 7 = 0 OR k % 9 = 0 OR k % 25 / 100 >= CASE WHEN c THEN 0.12::DOUBLE + 0.02::DOUBLE ELSE 0.12::DOUBLE END AS z,
  CASE WHEN k % 13 >= CASE WHEN l THEN 10 ELSE 8 END THEN 10 WHEN k % 10 >= 8 THEN 4 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END AS e FROM o),
s AS (SELECT *, CASE WHEN t THEN 25 ELSE 0 END + CASE WHEN n THEN 25 ELSE 0 END + CASE WHEN z THEN 20 ELSE 0 END + e AS p FROM f)
SELECT k AS image_id, p AS puntaje, t AND n AND z AS prioritario, CASE WHEN p >= 70 OR (t AND n AND z) THEN 'PRIORITARIO' WHEN p >= 45 THEN 'MEDIO' ELSE 'BAJO' END AS nivel FROM s"""


def q_confidence(spark, d):
    """Each event as one analysis of its user's image."""
    names = F.array(*[F.lit(n) for n in images.CONFIDENCE_POINTS])
    k = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.get(names, (k % 5).cast("int")).alias("analisis"), (k % 2 == 0).alias("detectado"), F.when(k % 3 == 0, F.when(k % 5 == 1, "ALTA").otherwise("ALTO")).when(k % 3 == 1, F.when(k % 5 == 1, "MEDIA").otherwise("MEDIO")).otherwise("BAJO").alias("nivel"))
    return images.confidence(e)


SQL["confidence"] = """WITH p AS (SELECT user_id AS image_id, CASE WHEN event_id % 5 < 2 THEN 3 ELSE 2 END AS mx, CASE WHEN event_id % 2 > 0 THEN 0 WHEN event_id % 5 < 2 THEN 3 - event_id % 3 ELSE 2 - event_id % 3 END AS v FROM events), g AS (SELECT image_id, sum(v) AS puntos, sum(mx) AS maximo FROM p GROUP BY 1)
SELECT image_id, puntos, maximo, round(puntos / maximo * 100, 1) AS porcentaje, CASE WHEN puntos / maximo * 100 >= 70 THEN 'ALTO' WHEN puntos / maximo * 100 >= 40 THEN 'MEDIO' ELSE 'BAJO' END AS grado FROM g"""


def q_manipulation_probability(spark, d):
    k = F.col("k")
    s = _orders(spark, d).select(k.alias("image_id"), (k % 2 == 0).alias("metadatos"), (k % 3 == 0).alias("bordes_rectos"), (k % 5 == 0).alias("uniforme"), (k % 7 > 2).alias("patron_texto"), (k % 4).alias("capas_ocultas"), F.when(k % 6 == 0, "ALTO").when(k % 6 < 3, "MEDIO").when(k % 6 < 5, "BAJO").alias("grado"))
    return images.manipulation_probability(s)


SQL["manipulation_probability"] = """WITH a AS (SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN o_orderkey % 7 > 2 THEN 0.4::DOUBLE ELSE 0 END, 4) AS s FROM orders),
p AS (SELECT k, s, round(least(1.0::DOUBLE, CASE WHEN k % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN s > 0.5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN k % 4 > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN k % 6 = 0 THEN 0.5::DOUBLE WHEN k % 6 < 3 THEN 0.3::DOUBLE WHEN k % 6 < 5 THEN 0.1::DOUBLE ELSE 0 END), 4) AS p FROM a)
SELECT k AS image_id, s AS superposicion, p AS probabilidad, CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS nivel FROM p"""


def _risk_docs(spark, d):
    k = F.col("k")
    stamp = lambda days: F.concat(F.lit("D:"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), days), "yyyyMMdd"), F.lit("080000"))
    return _orders(spark, d).select(
        k.alias("doc_id"), F.when(k % 9 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("fecha_emision"), stamp((k % 30).cast("int")).alias("creation_date"), stamp((k % 30 + k % 3).cast("int")).alias("mod_date"),
        (k % 4 > 0).alias("productor_conocido"), F.when(k % 8 == 0, "HIGH").when(k % 8 == 1, "MEDIUM").otherwise("LOW").alias("nivel_capas"), (k % 5).alias("fuentes"), ((k % 10) / 10).alias("dominante"),
        F.when(k % 6 > 0, (k % 200).cast("double")).alias("dpi_min"), F.lit(150.0).alias("dpi_media"), (k % 100).cast("double").alias("dpi_desviacion"), (k % 2).alias("filtros_raros"), F.when(k % 7 > 0, (k % 10) / 10).alias("alineacion"), ((k % 4) / 10).alias("rotacion"),
        (k % 11 == 0).alias("has_forms"), (k % 13 == 0).alias("has_js"), (k % 17 == 0).alias("has_embedded"), (k % 3 == 0).alias("tiene_firma"), (k % 2).alias("firmas_validas"), (k % 5 > 0).alias("documento_integro"), F.when(k % 4 == 0, "alto").otherwise("bajo").alias("nivel_seguridad"),
        (k % 5).alias("startxref"), (k % 19 == 0).alias("encrypted"), F.lit(None).cast("boolean").alias("estructura_sospechosa"), F.when(k % 10 > 0, k % 10 > 3).alias("sri_ok"), (k % 2 == 0).alias("firma_verificada"),
    )


_W = DEFAULT_WEIGHTS
_RISK = f"""o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 10 / 10 ELSE 1.0 END AS al, o_orderkey % 4 / 10 AS ro FROM orders), c AS (SELECT k,
  CASE WHEN k % 9 = 0 OR k % 30 > 10 THEN {_W['fecha_creacion_vs_emision']} ELSE 0 END AS p0,
  CASE WHEN k % 3 > 0 THEN {_W['fecha_mod_vs_creacion']} ELSE 0 END + CASE WHEN k % 4 > 0 THEN 0 ELSE {_W['software_conocido']} END + CASE WHEN k % 8 < 2 THEN {_W['capas_multiples']} ELSE 0 END AS p1,
  CASE WHEN k % 5 > 2 OR k % 10 / 10 < 0.4::DOUBLE THEN {_W['consistencia_fuentes']} WHEN k % 10 / 10 < 0.6::DOUBLE THEN {int(_W['consistencia_fuentes'] * 0.6)} ELSE 0 END
  + CASE WHEN k % 6 = 0 THEN 0 WHEN k % 200 < 90 THEN {_W['dpi_uniforme']} WHEN k % 100 / 150.0::DOUBLE > 0.35::DOUBLE THEN {int(_W['dpi_uniforme'] * 0.6)} ELSE 0 END + CASE WHEN k % 2 > 0 THEN {_W['compresion_estandar']} ELSE 0 END
  + CASE WHEN al < 0.7::DOUBLE OR ro > 0.2::DOUBLE THEN {_W['alineacion_texto']} WHEN al < 0.85::DOUBLE OR ro > 0.1::DOUBLE THEN {int(_W['alineacion_texto'] * 0.6)} ELSE 0 END AS p2,
  CASE WHEN k % 11 = 0 THEN {_W['anotaciones_o_formularios']} ELSE 0 END + CASE WHEN k % 13 = 0 THEN {_W['javascript_embebido']} ELSE 0 END + CASE WHEN k % 17 = 0 THEN {_W['archivos_incrustados']} ELSE 0 END
  + CASE WHEN k % 3 > 0 THEN 0 WHEN k % 5 > 0 THEN CASE WHEN k % 2 > 0 THEN CASE WHEN k % 4 = 0 THEN 18 ELSE 15 END ELSE CASE WHEN k % 4 = 0 THEN 12 ELSE 10 END END ELSE CASE WHEN k % 2 > 0 THEN CASE WHEN k % 4 = 0 THEN 4 ELSE 4 END ELSE 3 END END
  + CASE WHEN k % 5 >= 3 THEN {_W['actualizaciones_incrementales']} WHEN k % 5 > 1 THEN {int(_W['actualizaciones_incrementales'] * 0.6)} ELSE 0 END + CASE WHEN k % 19 = 0 THEN {_W['cifrado_permisos_extra']} ELSE 0 END AS p3 FROM o)"""
_LEVEL = "CASE WHEN score <= 25 THEN 'bajo' WHEN score <= 42 THEN 'medio' ELSE 'alto' END AS nivel"


def q_document_risk(spark, d):
    return document_risk.document_risk(_risk_docs(spark, d), default_weights(spark), default_levels(spark)).select("doc_id", "score", "penalty_prioritarias", "penalty_secundarias", "penalty_adicionales", "nivel")


SQL["document_risk"] = f"WITH {_RISK}, s AS (SELECT k AS doc_id, least(100, p1 + p2 + p3) AS score, p1 AS penalty_prioritarias, p2 AS penalty_secundarias, p3 AS penalty_adicionales FROM c) SELECT *, {_LEVEL} FROM s"


def q_invoice_risk(spark, d):
    return document_risk.invoice_risk(_risk_docs(spark, d), default_weights(spark), default_levels(spark))


SQL["invoice_risk"] = f"""WITH {_RISK}, b AS (SELECT k, least(100, p0 + p1 + p2 + p3) AS base, CASE WHEN k % 10 BETWEEN 1 AND 3 THEN {_W['sri_verificacion']} ELSE 0 END AS ps FROM c),
s AS (SELECT k AS doc_id, base, ps AS penalizacion_sri, least(100, base + ps) AS score FROM b) SELECT *, {_LEVEL} FROM s"""


def q_probable_fake(spark, d):
    k = F.col("doc_id")
    docs = _risk_docs(spark, d).withColumns({"has_layers": k % 5 == 0, "confianza_capas": (k % 10) / 10, "superpuesto": k % 7 == 0, "lineas_duplicadas": k % 6})
    return document_risk.probable_fake(docs)


SQL["probable_fake"] = "SELECT o_orderkey AS doc_id, (o_orderkey % 5 = 0 AND o_orderkey % 10 >= 7) OR o_orderkey % 3 > 1 OR (o_orderkey % 7 = 0 AND o_orderkey % 6 > 2) AS es_falso_probable FROM orders"

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
