"""Claims: filter, lookup, paging, statistics and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.session import cut_lineage
from cotejo.sources.claims import CLAIM_STATES


def filter_claims(claims: DataFrame, estado: str | None = None, proveedor: str | None = None) -> DataFrame:
    """State equal and provider name containing, both ignoring case."""
    if estado:
        claims = claims.where(F.lower("estado") == F.lower(F.lit(estado)))
    if proveedor:
        claims = claims.where(F.lower("proveedor.nombre").contains(F.lower(F.lit(proveedor))))
    return claims


def get_claim(claims: DataFrame, id_reclamo: str) -> DataFrame:
    return claims.where(F.col("id_reclamo") == id_reclamo)


def page_claims(claims: DataFrame, limit: int | None = None, offset: int = 0, key: str = "id_reclamo") -> DataFrame:
    """One page in key order; pair it with `claims.count()` for the total before paging."""
    page = claims.orderBy(key)
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)


def page_after(claims: DataFrame, after: str | None, limit: int, key: str = "id_reclamo") -> DataFrame:
    """The page behind the last key of the page before; the filter reaches the scan, so a deep page costs no more than the first."""
    rest = claims if after is None else claims.where(F.col(key) > after)
    return rest.orderBy(key).limit(limit)


def claim_stats(claims: DataFrame) -> DataFrame:
    """One row: total, counts per state as a map, requested and approved sums."""
    per_state = claims.groupBy("estado").agg(
        F.count(F.lit(1)).alias("n"), F.sum("monto_solicitado").alias("s"), F.sum("monto_aprobado").alias("a")
    )
    return per_state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reclamos"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("estado", "n")))).alias("por_estado"),
        F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 2).alias("total_solicitado"),
        F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 2).alias("total_aprobado"),
    )


def format_claim_id(number: Column) -> Column:
    """CLM-ddd-ddd; numbers beyond six digits keep all their digits after the first three."""
    digits = F.when(F.length(number.cast("string")) < 6, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    return F.concat(F.lit("CLM-"), F.substring(digits, 1, 3), F.lit("-"), F.substr(digits, F.lit(4)))


def last_number(claims: DataFrame) -> DataFrame:
    """Number of the last id in string order; 0 when there is none or it does not parse."""
    text = F.replace(F.replace(F.max("id_reclamo"), F.lit("CLM-"), F.lit("")), F.lit("-"), F.lit(""))
    return claims.agg(F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), F.lit(0)).alias("last"))


def next_claim_id(claims: DataFrame) -> DataFrame:
    return last_number(claims).select(format_claim_id(F.col("last") + 1).alias("next_id"))


def number_rows(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """Dense one-based numbers in global order, without one task seeing all rows.

    Rows are range-partitioned and fixed by a checkpoint (sampled ranges could differ between two
    evaluations); counts per partition give each partition its offset, and the window runs inside
    a partition only.
    """
    parts = cut_lineage(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = F.row_number().over(W.partitionBy("_p").orderBy(order))
    return (
        parts.withColumn("_in", inner)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_off") + F.col("_in"))
        .drop("_p", "_in", "_off")
    )


def insert_claims(claims: DataFrame, new: DataFrame, today: str, order: str = "seq") -> DataFrame:
    """Append claims with fresh ids in `order`; `new` holds proveedor, estado, monto_solicitado and moneda."""
    numbered = number_rows(new, order).withColumn("_k", F.lit(1))
    base = last_number(claims).withColumn("_k", F.lit(1))
    rows = numbered.join(F.broadcast(base), "_k").select(
        format_claim_id(F.col("last") + F.col("row_no")).alias("id_reclamo"),
        F.lit(today).alias("fecha_envio"),
        "proveedor",
        "estado",
        "monto_solicitado",
        F.lit(None).cast("double").alias("monto_aprobado"),
        "moneda",
        F.struct(F.lit(True).alias("ver"), F.col("estado").isin("En Revisión", "Rechazado").alias("subir")).alias("acciones"),
    )
    return claims.unionByName(rows.select(*claims.columns))


def update_claims(claims: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply (id_reclamo, estado, monto_aprobado) patches; null or empty means unchanged."""
    patch = patches.select(
        "id_reclamo", F.nullif("estado", F.lit("")).alias("_estado"), F.col("monto_aprobado").alias("_aprobado")
    )
    upload = F.when(F.col("_estado") == "Aprobado", False).when(F.col("_estado") == "Rechazado", True)
    return (
        claims.join(patch, "id_reclamo", "left")
        .withColumn("estado", F.coalesce("_estado", "estado"))
        .withColumn("monto_aprobado", F.coalesce("_aprobado", "monto_aprobado"))
        .withColumn("acciones", F.col("acciones").withField("subir", F.coalesce(upload, F.col("acciones.subir"))))
        .select(*claims.columns)
    )


def delete_claims(claims: DataFrame, ids: DataFrame) -> DataFrame:
    return claims.join(ids.select("id_reclamo"), "id_reclamo", "left_anti")


def missing_ids(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids asked for that do not exist; a non-empty result is the caller's error."""
    return ids.select("id_reclamo").join(claims.select("id_reclamo"), "id_reclamo", "left_anti")


def invalid_states(claims: DataFrame) -> DataFrame:
    return claims.where(~F.col("estado").isin(CLAIM_STATES))
