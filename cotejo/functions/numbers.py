"""Parsing of printed numbers. Unparsable text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cotejo.functions.binding import let
from cotejo.functions.text import WHITESPACE

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted names of each amount, in the order they are tried.
SUBTOTAL_KEYS = [
    "subtotalSinImpuestos", "subTotalSinImpuestos", "subtotal_sin_impuestos", "baseImponible", "base_imponible",
    "subtotal", "subtotal_total", "subtotal0", "subtotal12", "subtotal15", "subtotalIVA0", "subtotalIVA12",
    "subtotalIVA15", "subtotalSIN", "subtotalSinIva",
]
IVA_KEYS = [
    "iva", "totalIva", "iva12", "iva15", "valorIVA", "impuestoIVA", "ivaTotal", "iva_total", "ivaValor", "iva_valor",
]
DISCOUNT_KEYS = [
    "descuento", "descuentos", "totalDescuento", "totalDescuentos", "descuento_total", "valor_descuento",
]
RETENTION_KEYS = [
    "retencion", "retenciones", "totalRetencion", "totalRetenciones", "retencion_total", "valor_retencion",
]
TOTAL_KEYS = [
    "importeTotal", "total", "valorTotal", "totalFactura", "total_factura", "valor_total", "importe_total",
    "totalAPagar", "total_a_pagar",
]
TIP_KEYS = ["propina", "servicio", "service", "tip", "valor_propina"]

# Money shapes tried in order on one line.
MONEY_PATTERNS = [
    r"(-?\d{1,3}(?:[.,]\d{3})*[.,]\d{2})",
    r"(-?\d+[.,]\d{2})",
    r"(-?\d{1,3}(?:[.,]\d{3})+)",
    r"(-?\d+)",
]


def as_double(c: Column) -> Column:
    """Plain decimal text to double; Java-only spellings such as '5d' are refused."""
    return let(c, lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double")))


def to_float(c: Column) -> Column:
    """Comma as decimal mark; two marks make the text unparsable."""
    return as_double(F.replace(F.trim(c.cast("string"), F.lit(WHITESPACE)), F.lit(","), F.lit(".")))


def _last(c: Column, mark: str) -> Column:
    """Position of the last mark, 0 when absent."""
    return F.when(c.contains(mark), F.length(c) - F.length(F.substring_index(c, mark, -1))).otherwise(0)


def normalize_decimal(c: Column, variant: str = "capture") -> Column:
    """The later of comma and dot is the decimal mark.

    `capture`: a lone kind of mark is always decimal. `xml`: several dots without a comma are
    thousands marks, and only a single comma is decimal.
    """
    drop = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    dot = lambda x: F.replace(x, F.lit(","), F.lit("."))

    def plain(s: Column) -> Column:
        both = F.when(_last(s, ",") > _last(s, "."), dot(drop(s, "."))).otherwise(drop(s, ","))
        if variant == "xml":
            n_comma = F.length(s) - F.length(drop(s, ","))
            n_dot = F.length(s) - F.length(drop(s, "."))
            lone = F.when((n_comma == 1) & (n_dot == 0), dot(s)).when((n_dot > 1) & (n_comma == 0), drop(s, ".")).otherwise(s)
        else:
            lone = dot(s)
        return F.when(s.contains(",") & s.contains("."), both).otherwise(lone)

    # digits with at most one dot read the same in every spelling
    usual = lambda x: F.when(x.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), x.try_cast("double")).otherwise(as_double(let(F.trim(x, F.lit(WHITESPACE)), plain)))
    return let(c, usual)


def norm_amount(c: Column) -> Column:
    """Every mark becomes a dot and the last one is decimal."""
    s = F.translate(F.trim(c, F.lit(WHITESPACE)), ", ", ".")
    return as_double(F.regexp_replace(s, r"\.(?=.*\.)", ""))


def clean_amount(c: Column, variant: str = "trailing") -> Column:
    """`trailing`: comma before two final digits is decimal, other commas are thousands marks.
    `mixed`: any mixture, last mark is decimal, result rounded to cents.
    """
    if variant == "trailing":
        s = F.regexp_replace(c, r"([0-9]),([0-9]{2})$", "$1.$2")
        return as_double(F.regexp_replace(s, r"([0-9]),([0-9]{3})", "$1$2"))
    def plain(s: Column) -> Column:
        n_marks = F.length(s) - F.length(F.translate(s, ".,", ""))
        several = F.when(_last(s, ",") > _last(s, "."), F.translate(s, ",.", ".")).otherwise(F.translate(s, ".,", "."))
        return F.when(n_marks > 1, several).otherwise(F.translate(s, ",", "."))

    return F.bround(as_double(let(F.regexp_replace(c, r"[^0-9.,]", ""), plain)), 2)


def first_money(c: Column) -> Column:
    """First non-negative amount of a line, by pattern order and then position."""
    tries = []
    for pattern in MONEY_PATTERNS:
        values = F.transform(
            F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: as_double(F.replace(x, F.lit(","), F.lit(".")))
        )
        tries.append(F.get(F.filter(values, lambda v: v >= 0), F.lit(0)))
    return F.coalesce(*tries)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def ramp(c: Column, lo: float, hi: float, points: float) -> Column:
    """Rescale [lo, hi] to [0, points] and clamp."""
    return clamp((c - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0) * F.lit(float(points))


def pick(*cols: Column) -> Column:
    """First column that parses as a number."""
    return F.coalesce(*[to_float(c) for c in cols])


def pick_field(fields: Column, keys: list[str]) -> Column:
    """`pick` over a map of loose fields, by alias order."""
    return pick(*[F.try_element_at(fields, F.lit(k)) for k in keys])


def truthy(c: Column) -> Column:
    """Zero counts as missing, as in the `a or b` chains of the amount rules."""
    return F.when(c != 0, c)
