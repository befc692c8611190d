"""Ecuadorian identifiers: access key, personal id and taxpayer number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cotejo.functions.binding import let
from cotejo.functions.text import digits_only, ocr_digits

# Voucher and emission type names by code.
VOUCHER_TYPES = {
    "01": "Factura",
    "04": "Nota de Crédito",
    "05": "Nota de Débito",
    "06": "Guía de Remisión",
    "07": "Comprobante de Retención",
    "08": "Liquidación de Compra",
    "09": "Liquidación de Venta",
}
EMISSION_TYPES = {"1": "Normal", "2": "Indisponibilidad del Sistema", "3": "Contingencia"}

# 1-based start and length of the parts of a 49-digit access key.
KEY_PARTS = {
    "fecha": (1, 8),
    "codDoc": (9, 2),
    "ruc": (11, 13),
    "ambiente": (24, 1),
    "serie": (25, 6),
    "secuencial": (31, 9),
    "codigoNumerico": (40, 8),
    "tipoEmision": (48, 1),
    "dv": (49, 1),
}


def _digit(c: Column, pos: int) -> Column:
    return F.ascii(F.substring(c, pos, 1)) - 48


def _weighted(c: Column, weights: list[int]) -> Column:
    """Sum of digit times weight, folded over the places: written out, the sum makes a method too long for the compiler."""
    places = F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    return let(c, lambda x: F.aggregate(places, F.lit(0), lambda a, p: a + (F.ascii(F.substring(x, p["at"], F.lit(1))) - 48) * p["w"]))


# check digit by remainder: 0 stays 0, 1 becomes 1, else 11 less the remainder
_DIGIT_BY_REMAINDER = [0, 1, 9, 8, 7, 6, 5, 4, 3, 2, 1]
_WEIGHTS = [2 + (47 - i) % 6 for i in range(48)]


def _check_digit(total: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in _DIGIT_BY_REMAINDER]), total % 11)


def check_digit_mod11(base48: Column) -> Column:
    """Weights 2..7 repeat from the right; 11 becomes 0 and 10 becomes 1."""
    return _check_digit(_weighted(base48, _WEIGHTS))


def key_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{49}$") & (check_digit_mod11(c) == _digit(c, 49)), F.lit(False))


def key_check(c: Column) -> Column:
    """struct(ok, reason, dv_calc, ambiente_estandar)."""
    is_num = c.rlike(r"^[0-9]+$")

    def verdict(dv: Column) -> Column:
        reason = (
            F.when(c.isNull() | (F.length(c) != 49), "longitud")
            .when(~is_num, "no_numerica")
            .when(dv != _digit(c, 49), "digito_verificador")
            .otherwise("valida")
        )
        return F.struct(
            (reason == "valida").alias("ok"),
            reason.alias("reason"),
            dv.alias("dv_calc"),
            F.when(dv.isNotNull(), F.substring(c, 24, 1).isin("1", "2")).alias("ambiente_estandar"),
        )

    return let(F.when(c.rlike(r"^[0-9]{49}$"), check_digit_mod11(c)), verdict)


def _lookup(table: dict[str, str], code: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, code), F.lit("Desconocido"))


def key_parts(c: Column) -> Column:
    """The nine parts of a key plus the names behind its codes."""
    parts = [F.substring(c, start, size).alias(name) for name, (start, size) in KEY_PARTS.items()]
    return F.struct(
        *parts,
        _lookup(VOUCHER_TYPES, F.substring(c, *KEY_PARTS["codDoc"])).alias("tipo_comprobante"),
        _lookup(EMISSION_TYPES, F.substring(c, *KEY_PARTS["tipoEmision"])).alias("tipo_emision"),
    )


def repair_key(c: Column) -> Column:
    """Complete 48 digits, or undo one 4 read for 1 or 7; an unrepairable key comes back unchanged.

    Replacing a 4 at a place of weight w moves the weighted sum by -3w or +3w, so the sum is taken
    once and every place is tested on it.
    """

    def undo(d: Column) -> Column:
        def fix(total: Column) -> Column:
            dv = _digit(d, 49)
            fits = {(w, r): _check_digit(total + (r - 4) * w) == dv for w in range(2, 8) for r in (1, 7)}
            tries = [
                F.when((F.substring(d, i + 1, 1) == "4") & fits[(_WEIGHTS[i], r)], F.overlay(d, F.lit(str(r)), F.lit(i + 1)))
                for i in range(48)
                for r in (1, 7)
            ]
            return F.when(_check_digit(total) == dv, d).otherwise(F.coalesce(*tries, d))

        return let(_weighted(d, _WEIGHTS), fix)

    return let(
        digits_only(F.coalesce(c, F.lit(""))),
        lambda d: F.when(F.length(d) == 48, F.concat(d, check_digit_mod11(d).cast("string"))).when(F.length(d) == 49, undo(d)).otherwise(d),
    )


#: a day, month and year at the head of a key
_DATED = r"^(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(19|20)[0-9]{2}"


def key_windows(digits: Column) -> Column:
    """All stretches of 49 digits in order."""
    at = F.when(F.length(digits) >= 49, F.sequence(F.lit(1), F.length(digits) - 48)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(digits, i, F.lit(49)))


def first_dated(keys: Column) -> Column:
    """First key that begins with a date; one window in eleven has a valid check digit by chance."""
    return F.get(F.filter(keys, lambda k: k.rlike(_DATED)), F.lit(0))


def repair_key_swaps(c: Column) -> Column:
    """Letters to digits, then the first valid window of 49 digits as it stands or after whole-string swaps of 4/1, 1/4, 7/4 and 4/7.

    In more than 49 digits windows that begin with a date go first; null if none is valid.
    """

    def tries(d: Column) -> Column:
        swapped = F.flatten(F.array(*[key_windows(F.translate(d, a, b)) for a, b in (("4", "1"), ("1", "4"), ("7", "4"), ("4", "7"))]))
        both = F.array(F.filter(key_windows(d), key_valid), F.filter(swapped, key_valid))
        alone = F.length(d) == 49
        return let(
            both,
            lambda v: F.coalesce(
                F.when(~alone, F.coalesce(first_dated(F.get(v, F.lit(0))), first_dated(F.get(v, F.lit(1))))), F.get(F.flatten(v), F.lit(0))
            ),
        )

    return let(digits_only(ocr_digits(c, "pdf")), tries)


def cedula_ok(c: Column) -> Column:
    """Province 1-24 and a mod-10 check digit with weights 2, 1, 2, ..."""
    shape = c.rlike(r"^[0-9]{10}$")
    terms = []
    for i in range(9):
        product = _digit(c, i + 1) * (2 if i % 2 == 0 else 1)
        terms.append(F.when(product > 9, product - 9).otherwise(product))
    total = reduce(lambda a, b: a + b, terms)
    province = F.substring(c, 1, 2).try_cast("int").between(1, 24)
    return F.coalesce(shape & province & ((F.lit(10) - total % 10) % 10 == _digit(c, 10)), F.lit(False))


def ruc_ok(c: Column) -> Column:
    """Rule chosen by the third digit: person, public body or company."""
    shape = c.rlike(r"^[0-9]{13}$") & F.substring(c, 1, 2).try_cast("int").between(1, 24)
    third = _digit(c, 3)

    def mod11(weights: list[int], at: int) -> Column:
        raw = F.lit(11) - _weighted(c, weights) % 11
        return F.when(raw == 11, 0).otherwise(raw) == _digit(c, at)

    person = cedula_ok(F.substring(c, 1, 10)) & c.endswith("001")
    public = mod11([3, 2, 7, 6, 5, 4, 3, 2], 9) & c.endswith("0001")
    company = mod11([4, 3, 2, 7, 6, 5, 4, 3, 2], 10) & c.endswith("001")
    verdict = F.when(third < 6, person).when(third == 6, public).when(third == 9, company).otherwise(False)
    return F.coalesce(shape & verdict, F.lit(False))
