"""Registered queries on claims and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import claims as ops, config_tables, scoring
from cotejo.plans.derived import CLAIMS_SQL, claims, table
from cotejo.sources.config import DEFAULT_WEIGHTS, SHIPPED_LEVELS, default_levels, default_weights

Q, SQL = {}, {}


def _flat(df):
    return df.select("id_reclamo", "estado", "monto_solicitado", "monto_aprobado", F.col("acciones.subir").alias("subir"))


_FLAT = "id_reclamo, estado, monto_solicitado, monto_aprobado, subir"


def q_claims_filter(spark, d):
    return _flat(ops.filter_claims(claims(spark, d), estado="APROBADO", proveedor="clínica 1"))


SQL["claims_filter"] = f"""WITH {CLAIMS_SQL} SELECT {_FLAT} FROM claims
WHERE lower(estado) = 'aprobado' AND contains(lower(nombre), 'clínica 1')"""


def q_claim_lookup(spark, d):
    return _flat(ops.get_claim(claims(spark, d), "CLM-000-000042"))


SQL["claim_lookup"] = f"WITH {CLAIMS_SQL} SELECT {_FLAT} FROM claims WHERE id_reclamo = 'CLM-000-000042'"


def q_claims_page(spark, d):
    return _flat(ops.page_claims(claims(spark, d), limit=50, offset=100))


SQL["claims_page"] = f"WITH {CLAIMS_SQL} SELECT {_FLAT} FROM claims ORDER BY id_reclamo LIMIT 50 OFFSET 100"


def q_claims_page_after(spark, d):
    return _flat(ops.page_after(claims(spark, d), "CLM-000-000100", 50))


SQL["claims_page_after"] = f"WITH {CLAIMS_SQL} SELECT {_FLAT} FROM claims WHERE id_reclamo > 'CLM-000-000100' ORDER BY id_reclamo LIMIT 50"


def q_claims_stats(spark, d):
    stats = ops.claim_stats(claims(spark, d))
    counts = [F.try_element_at("por_estado", F.lit(s)).alias(n) for s, n in (("Aprobado", "aprobados"), ("En Revisión", "en_revision"), ("Rechazado", "rechazados"))]
    return stats.select("total_reclamos", *counts, "total_solicitado", "total_aprobado")


SQL["claims_stats"] = f"""WITH {CLAIMS_SQL}
SELECT count(*) AS total_reclamos, count(*) FILTER (estado = 'Aprobado') AS aprobados, count(*) FILTER (estado = 'En Revisión') AS en_revision,
       count(*) FILTER (estado = 'Rechazado') AS rechazados, round(sum(monto_solicitado), 2) AS total_solicitado,
       round(sum(monto_aprobado), 2) AS total_aprobado FROM claims"""


def q_claims_next_id(spark, d):
    return ops.next_claim_id(claims(spark, d))


SQL["claims_next_id"] = f"""WITH {CLAIMS_SQL}, n AS (
  SELECT CAST(replace(replace(max(id_reclamo), 'CLM-', ''), '-', '') AS BIGINT) + 1 AS n FROM claims)
SELECT 'CLM-' || substr(t, 1, 3) || '-' || substr(t, 4) AS next_id
FROM (SELECT CASE WHEN length(CAST(n AS VARCHAR)) < 6 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS t FROM n)"""


def q_claims_insert(spark, d):
    """Customers as new claims behind the existing ones."""
    new = table(spark, d, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.struct(F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("tipo_servicio")).alias("proveedor"),
        F.when(F.col("c_custkey") % 2 == 0, "En Revisión").otherwise("Aprobado").alias("estado"),
        F.col("c_acctbal").alias("monto_solicitado"),
        F.lit("$").alias("moneda"),
    )
    return _flat(ops.insert_claims(claims(spark, d), new, "01/01/2026"))


SQL["claims_insert"] = f"""WITH {CLAIMS_SQL}, last AS (
  SELECT CAST(replace(replace(max(id_reclamo), 'CLM-', ''), '-', '') AS BIGINT) AS n FROM claims
), fresh AS (
  SELECT CAST(n + row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS k, c_acctbal, c_custkey % 2 = 0 AS even FROM customer, last
), padded AS (SELECT CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS k, c_acctbal, even FROM fresh)
SELECT {_FLAT} FROM claims UNION ALL
SELECT 'CLM-' || substr(k, 1, 3) || '-' || substr(k, 4), CASE WHEN even THEN 'En Revisión' ELSE 'Aprobado' END, c_acctbal, NULL, even
FROM padded"""


def _patches(spark, d):
    c = claims(spark, d)
    n = F.substring("id_reclamo", -2, 2).cast("int")
    return c.where(n < 60).select(
        "id_reclamo",
        F.when(n % 3 == 0, "Aprobado").when(n % 3 == 1, "Rechazado").otherwise("").alias("estado"),
        F.when(n % 2 == 0, F.lit(12.5)).alias("monto_aprobado"),
    )


def q_claims_update(spark, d):
    return _flat(ops.update_claims(claims(spark, d), _patches(spark, d)))


SQL["claims_update"] = f"""WITH {CLAIMS_SQL}, p AS (SELECT *, o_orderkey % 100 AS n FROM claims)
SELECT id_reclamo, CASE WHEN n < 60 AND n % 3 = 0 THEN 'Aprobado' WHEN n < 60 AND n % 3 = 1 THEN 'Rechazado' ELSE estado END AS estado,
       monto_solicitado, CASE WHEN n < 60 AND n % 2 = 0 THEN 12.5::DOUBLE ELSE monto_aprobado END AS monto_aprobado,
       CASE WHEN n < 60 AND n % 3 = 0 THEN false WHEN n < 60 AND n % 3 = 1 THEN true ELSE subir END AS subir FROM p"""


def _ids(spark, d):
    c = claims(spark, d)
    n = F.substring("id_reclamo", -1, 1).cast("int")
    return c.where(n.isin(3, 7)).select(F.when(n == 7, F.concat(F.lit("X"), "id_reclamo")).otherwise(F.col("id_reclamo")).alias("id_reclamo"))


def q_claims_delete(spark, d):
    return _flat(ops.delete_claims(claims(spark, d), _ids(spark, d)))


SQL["claims_delete"] = f"WITH {CLAIMS_SQL} SELECT {_FLAT} FROM claims WHERE o_orderkey % 10 <> 3"


def q_claims_missing(spark, d):
    return ops.missing_ids(claims(spark, d), _ids(spark, d))


SQL["claims_missing"] = f"WITH {CLAIMS_SQL} SELECT 'X' || id_reclamo AS id_reclamo FROM claims WHERE o_orderkey % 10 = 7"


def q_claims_invalid_state(spark, d):
    raw = claims(spark, d).withColumn("estado", F.when(F.col("monto_solicitado") > 400000, F.col("estado")).otherwise(F.upper("estado")))
    return ops.invalid_states(raw).select("id_reclamo", "estado")


SQL["claims_invalid_state"] = f"WITH {CLAIMS_SQL} SELECT id_reclamo, upper(estado) AS estado FROM claims WHERE NOT monto_solicitado > 400000"


def _weight_rows():
    return ", ".join(f"('{k}', {v})" for k, v in DEFAULT_WEIGHTS.items())


def q_weights_detailed(spark, d):
    """Weights of the checks with texts taken from the part table, and how often each is charged."""
    descriptions = table(spark, d, "part").groupBy((F.col("p_partkey") % 30).alias("_k")).agg(
        F.min("p_name").alias("descripcion"), F.max("p_type").alias("explicacion"), F.count(F.lit(1)).cast("int").alias("valor")
    )
    keys = F.array(*[F.lit(k) for k in DEFAULT_WEIGHTS])
    named = descriptions.withColumn("check_key", F.get(keys, F.col("_k").cast("int"))).where(F.col("check_key").isNotNull() & (F.col("_k") % 4 > 0))
    return config_tables.weights_detailed(default_weights(spark), named.drop("_k"))


_KEYS = ", ".join(f"'{k}'" for k in DEFAULT_WEIGHTS)
SQL["weights_detailed"] = f"""WITH w(check_key, weight) AS (VALUES {_weight_rows()}),
d AS (SELECT p_partkey % 30 AS k, min(p_name) AS descripcion, max(p_type) AS explicacion FROM part GROUP BY 1),
n AS (SELECT list_extract([{_KEYS}], CAST(k + 1 AS BIGINT)) AS check_key, descripcion, explicacion FROM d WHERE k < {len(DEFAULT_WEIGHTS)} AND k % 4 > 0)
SELECT w.check_key, w.weight AS valor, coalesce(descripcion, 'Sin descripción') AS descripcion,
       coalesce(explicacion, 'Sin explicación') AS explicacion FROM w LEFT JOIN n ON n.check_key = w.check_key"""


def _event_levels(spark, d):
    """Score ranges per event type, as an uploaded level table would hold them."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.floor(F.min("value")).cast("int").alias("lo"), F.floor(F.max("value") / 4).cast("int").alias("hi")
    ).select(F.col("event_type").alias("level"), "lo", "hi")


def q_levels_validate(spark, d):
    return config_tables.validate_levels(_event_levels(spark, d))


SQL["levels_validate"] = """WITH l AS (
  SELECT event_type AS level, CAST(floor(min(value)) AS INT) AS lo, CAST(floor(max(value) / 4) AS INT) AS hi FROM events GROUP BY 1
), o AS (SELECT *, lead(lo) OVER (ORDER BY lo, level) AS nlo FROM l)
SELECT 'error' AS kind, level, 'nombre_desconocido' AS error FROM o WHERE level NOT IN ('bajo', 'medio', 'alto')
UNION ALL SELECT 'error', level, 'fuera_de_0_100' FROM o WHERE lo < 0 OR hi > 100
UNION ALL SELECT 'error', level, 'minimo_no_menor' FROM o WHERE lo >= hi
UNION ALL SELECT 'error', level, 'solapamiento' FROM o WHERE hi >= nlo
UNION ALL SELECT 'error', n, 'falta' FROM (SELECT unnest(['bajo', 'medio', 'alto']) AS n) WHERE n NOT IN (SELECT level FROM l)
UNION ALL SELECT 'aviso', NULL, 'hueco_inicial' FROM l HAVING min(lo) > 0
UNION ALL SELECT 'aviso', NULL, 'hueco_final' FROM (SELECT hi FROM l ORDER BY lo DESC, level DESC LIMIT 1) WHERE hi < 100"""


def q_weights_validate(spark, d):
    """A proposed weight table, one row per part type, against the current one."""
    new = table(spark, d, "part").groupBy("p_type").agg(F.max("p_size").alias("s")).select(
        F.col("p_type").alias("check_key"), F.when(F.col("s") % 2 == 0, F.col("s").cast("string")).otherwise(F.lit("alto")).alias("weight")
    )
    return config_tables.validate_weights(new, default_weights(spark))


SQL["weights_validate"] = f"""WITH w(check_key, weight) AS (VALUES {_weight_rows()})
SELECT p_type AS check_key, 'desconocida' AS error FROM part WHERE p_type NOT IN (SELECT check_key FROM w) GROUP BY 1
UNION ALL SELECT check_key, 'falta' FROM w WHERE check_key NOT IN (SELECT p_type FROM part)"""


def q_score_levels(spark, d):
    """Level of every order from a score given by its price."""
    scores = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") / 4500).cast("int").alias("score"))
    return scoring.assign_level(scores, default_levels(spark, {**SHIPPED_LEVELS, "alto": (43, 90)}))


SQL["score_levels"] = """SELECT doc_id, score, CASE WHEN score BETWEEN 26 AND 42 THEN 'medio' WHEN score BETWEEN 43 AND 90 THEN 'alto' ELSE 'bajo' END AS nivel
FROM (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice / 4500) AS INT) AS score FROM orders)"""


def q_max_level(spark, d):
    """Highest level over the events of each user."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.when(F.col("value") > 400, "HIGH").when(F.col("value") > 250, "MEDIUM").otherwise("LOW").alias("nivel")
    )
    return scoring.max_level(e, ["doc_id"])


SQL["max_level"] = """SELECT user_id AS doc_id, CASE WHEN max(value) > 400 THEN 'HIGH' WHEN max(value) > 250 THEN 'MEDIUM' ELSE 'LOW' END AS nivel_riesgo
FROM events GROUP BY 1"""

Q.update({n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")})
