"""Long table of checks to score and level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SECTIONS = ("prioritarias", "secundarias", "adicionales")


def explode_checks(df: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """Turn one wide row per document into its check rows in a single narrow step.

    Each check is (section, check_key, detail, penalty); no union, so the input is read once.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.lit(key).alias("check_key"),
                detail.cast("string").alias("detail"),
                F.coalesce(penalty.cast("int"), F.lit(0)).alias("penalty"),
            )
            for section, key, detail, penalty in checks
        ]
    )
    return df.select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*")


def score_documents(checks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sum of penalties clamped to 0..100, with the sum of each section."""
    sections = [
        F.coalesce(F.sum(F.when(F.col("section") == s, F.col("penalty"))), F.lit(0)).alias(f"penalty_{s}") for s in SECTIONS
    ]
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.sum("penalty")))
    return checks.groupBy(*keys).agg(
        clamped.cast("int").alias("score"), *sections, F.count_if(F.col("penalty") != 0).alias("n_penalised")
    )


def assign_level(scores: DataFrame, levels: DataFrame, default: str = "bajo") -> DataFrame:
    """First level whose inclusive range holds the score; outside every range the default.

    Scores are whole numbers from 0 to 100, so the ranges unfold into at most 101 rows: a bound that
    holds for any level table, which makes the broadcast safe and turns the range join into an
    equality.
    """
    lo, hi = F.greatest(F.lit(0), F.col("lo")), F.least(F.lit(100), F.col("hi"))
    by_score = (
        levels.where(lo <= hi)
        .select("level_no", "level", F.explode(F.sequence(lo, hi)).alias("score"))
        .groupBy("score")
        .agg(F.min_by("level", "level_no").alias("_level"))
    )
    joined = scores.join(F.broadcast(by_score), "score", "left")
    return joined.withColumn("nivel", F.coalesce("_level", F.lit(default))).select(*scores.columns, "nivel")


def max_level(levels_long: DataFrame, keys: Sequence[str], level: str = "nivel") -> DataFrame:
    """Highest of HIGH, MEDIUM and LOW per key over any number of analyses."""
    rank = F.when(F.col(level) == "HIGH", 2).when(F.col(level) == "MEDIUM", 1).otherwise(0)
    top = F.max(rank)
    return levels_long.groupBy(*keys).agg(F.when(top == 2, "HIGH").when(top == 1, "MEDIUM").otherwise("LOW").alias("nivel_riesgo"))
