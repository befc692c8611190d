"""Claim files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo import schemas

# The states a claim may have.
CLAIM_STATES = ["En Revisión", "Aprobado", "Rechazado"]


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(schemas.CLAIM_FILE).option("multiLine", "true").json(path)
    return files.select(F.explode("reclamos").alias("c")).select("c.*")


def read_claim_metadata(spark: SparkSession, path: str) -> DataFrame:
    """File-level metadata with defaults where the block is missing."""
    files = spark.read.schema(schemas.CLAIM_FILE).option("multiLine", "true").json(path)
    states = F.array(*[F.lit(s) for s in CLAIM_STATES])
    return files.select(
        F.coalesce("metadatos.total_reclamos", F.size(F.coalesce("reclamos", F.array())).cast("bigint")).alias("total_reclamos"),
        F.col("metadatos.ultima_actualizacion").alias("ultima_actualizacion"),
        F.coalesce("metadatos.estados_disponibles", states).alias("estados_disponibles"),
    )


def write_claims(claims: DataFrame, path: str, version: str) -> str:
    """A new version folder each time, so a table is never overwritten while it is read."""
    target = f"{path.rstrip('/')}/version={version}"
    claims.write.mode("errorifexists").parquet(target)
    return target


def claim_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in CLAIM_STATES], "estado string")
