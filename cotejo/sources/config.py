"""Risk weights, their descriptions and the score levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Weight of each check.
DEFAULT_WEIGHTS = {
    "fecha_creacion_vs_emision": 16,
    "fecha_mod_vs_creacion": 12,
    "software_conocido": 12,
    "capas_multiples": 30,
    "consistencia_fuentes": 15,
    "dpi_uniforme": 15,
    "compresion_estandar": 6,
    "alineacion_texto": 15,
    "anotaciones_o_formularios": 3,
    "javascript_embebido": 2,
    "archivos_incrustados": 3,
    "firmas_pdf": 10,
    "actualizaciones_incrementales": 3,
    "cifrado_permisos_extra": 2,
    "math_consistency": 10,
    "validacion_financiera": 15,
    "sri_verificacion": 20,
    "extraccion_texto_ocr": 30,
    "inconsistencias_ruido_bordes": 5,
    "analisis_ela_sospechoso": 5,
    "metadatos_sospechosos": 5,
    "texto_superpuesto": 25,
    "capas_ocultas": 20,
    "evidencias_forenses": 15,
}

# Inclusive score ranges, first those of the shipped file, then the reset ones.
SHIPPED_LEVELS = {"bajo": (0, 25), "medio": (26, 42), "alto": (43, 100)}
RESET_LEVELS = {"bajo": (0, 29), "medio": (30, 59), "alto": (60, 100)}


def default_weights(spark: SparkSession, weights: dict[str, int] | None = None) -> DataFrame:
    rows = ", ".join(f"('{k}', {v})" for k, v in (weights or DEFAULT_WEIGHTS).items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(check_key, weight)")


def default_levels(spark: SparkSession, levels: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    ranges = (levels or SHIPPED_LEVELS).items()
    rows = ", ".join(f"({i}, '{name}', {lo}, {hi})" for i, (name, (lo, hi)) in enumerate(ranges))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(level_no, level, lo, hi)")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of name to integer."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("check_key", "weight"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    entry = "map<string, struct<valor: int, descripcion: string, explicacion: string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", entry)).alias("check_key", "d")).select("check_key", "d.*")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """Name to [low, high]; the order in the file decides ties, so it is kept."""
    text = spark.read.text(path, wholetext=True)
    ranges = F.from_json("value", "map<string, array<int>>")
    names = F.json_object_keys("value")
    return text.select(F.posexplode(names).alias("level_no", "level"), ranges.alias("r")).select(
        "level_no", "level", F.col("r")[F.col("level")][0].alias("lo"), F.col("r")[F.col("level")][1].alias("hi")
    )


def write_config(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
