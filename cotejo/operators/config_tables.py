"""Checks and views over the small configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cotejo.skew import bounded_broadcast
from cotejo.sources.config import RESET_LEVELS, default_levels, write_config


LEVEL_NAMES = ["bajo", "medio", "alto"]


def weights_detailed(weights: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Weights with texts; a missing description gets the default texts."""
    return weights.join(bounded_broadcast(descriptions.drop("valor")), "check_key", "left").select(
        "check_key",
        F.col("weight").alias("valor"),
        F.coalesce("descripcion", F.lit("Sin descripción")).alias("descripcion"),
        F.coalesce("explicacion", F.lit("Sin explicación")).alias("explicacion"),
    )


def weight_totals(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.agg(
        F.count(F.lit(1)).alias("total_criterios"),
        F.max(F.when(w > 0, w)).alias("peso_maximo_positivo"),
        F.coalesce(F.min(F.when(w < 0, w)), F.lit(0)).alias("peso_maximo_negativo"),
    )


def validate_weights(new: DataFrame, current: DataFrame) -> DataFrame:
    """Errors of a proposed weight table (key text, value text); empty means it may replace the current one."""
    n = new.select("check_key", F.col("weight").cast("string").alias("_new"), F.lit(True).alias("_in_new"))
    c = current.select("check_key", F.lit(True).alias("_in_cur"))
    error = (
        F.when(F.col("_in_new").isNull(), "falta")
        .when(F.col("_in_cur").isNull(), "desconocida")
        .when(~F.coalesce(F.col("_new").rlike(r"^-?[0-9]+$"), F.lit(False)), "no_entero")
    )
    return n.join(c, "check_key", "full").select("check_key", error.alias("error")).where("error is not null")


def validate_levels(levels: DataFrame) -> DataFrame:
    """Problems of a level table as (kind, level, error); kind is `error` or `aviso`.

    The table is a handful of rows by contract, so one ordered window over it is bounded.
    """
    order = W.orderBy("lo", "level")
    seen = levels.withColumn("_next_lo", F.lead("lo").over(order)).withColumn("_next", F.lead("level").over(order))
    lo, hi = F.col("lo"), F.col("hi")
    found = F.array_compact(
        F.array(
            F.when(~F.col("level").isin(LEVEL_NAMES), "nombre_desconocido"),
            F.when((lo < 0) | (hi > 100), "fuera_de_0_100"),
            F.when(lo >= hi, "minimo_no_menor"),
            F.when(hi >= F.col("_next_lo"), "solapamiento"),
        )
    )
    errors = seen.select(F.lit("error").alias("kind"), "level", F.explode(found).alias("error"))
    edges = levels.agg(
        F.min("lo").alias("lo"),
        F.max_by("hi", F.struct("lo", "level")).alias("hi"),
        F.array_except(F.array(*[F.lit(n) for n in LEVEL_NAMES]), F.collect_set("level")).alias("_absent"),
    )
    gaps = F.array_compact(F.array(F.when(F.col("lo") > 0, "hueco_inicial"), F.when(F.col("hi") < 100, "hueco_final")))
    warnings = edges.select(F.lit("aviso").alias("kind"), F.lit(None).cast("string").alias("level"), F.explode(gaps).alias("error"))
    absent = edges.select(F.lit("error").alias("kind"), F.explode("_absent").alias("level"), F.lit("falta").alias("error"))
    return errors.unionByName(absent).unionByName(warnings)


def replace_config(new: DataFrame, errors: DataFrame, path: str) -> None:
    """Write a new weight or level table unless its validation found errors (warnings pass)."""
    found = errors.where("kind = 'error'") if "kind" in errors.columns else errors
    bad = [str(r["error"]) for r in found.collect()]
    if bad:
        raise ValueError("; ".join(bad))
    write_config(new, path)


def reset_levels(spark) -> DataFrame:
    return default_levels(spark, RESET_LEVELS)
