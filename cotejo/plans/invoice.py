"""Invoice arithmetic rolled up into a score and a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.operators import finance, scoring


def formula_checks(totals: DataFrame, items: DataFrame) -> DataFrame:
    """Check rows for formula, lines, VAT and anomalies with the weights of the financial score."""
    wide = finance.document_findings(totals, items)
    bad, odd = F.col("items_con_errores"), F.col("total_anomalias")
    return scoring.explode_checks(
        wide,
        ["doc_id"],
        [
            ("prioritarias", "formula", F.col("diferencia"), F.when(~F.col("formula_correcta"), 30).otherwise(0)),
            ("prioritarias", "lineas", bad, F.when(bad > 0, 20).otherwise(0)),
            ("secundarias", "iva", F.col("porcentaje_iva"), F.when(~F.col("iva_coherente"), 15).otherwise(0)),
            ("adicionales", "anomalias", odd, F.least(F.lit(20), odd * 5)),
        ],
    )


def invoice_levels(totals: DataFrame, items: DataFrame, levels: DataFrame) -> DataFrame:
    return scoring.assign_level(scoring.score_documents(formula_checks(totals, items)), levels)
