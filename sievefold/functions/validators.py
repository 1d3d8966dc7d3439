"""Check-digit validators as Column expressions. Null and malformed values are not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the check digits.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
PIS_WEIGHTS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _at(value: Column, k: int) -> Column:
    """Value of the character at k, counted from 0: its code less 48."""
    return F.ascii(F.substring(value, k + 1, 1)) - 48


def _weighted(value: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + _at(value, k) * w
    return total


def _varied(value: Column) -> Column:
    return ~value.rlike(r"^(.)\1*$")


def cpf(value: Column) -> Column:
    d = digits(value)
    right = [(_weighted(d, w) * 10 % 11) % 10 == _at(d, len(w)) for w in CPF_WEIGHTS]
    return F.coalesce(F.when(F.length(d) == 11, _varied(d) & right[0] & right[1]), F.lit(False))


def cnpj(value: Column) -> Column:
    s = F.regexp_replace(value, r"[.\-/\s]", "")

    def right(weights: tuple[int, ...]) -> Column:
        rest = _weighted(s, weights) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest) == _at(s, len(weights))

    shaped = s.rlike("^[0-9A-Z]{12}[0-9]{2}$") & ~value.rlike("[a-z]")
    return F.coalesce(F.when(shaped, _varied(s) & right(CNPJ_WEIGHTS[0]) & right(CNPJ_WEIGHTS[1])), F.lit(False))


def card(value: Column) -> Column:
    d = digits(value)
    return F.coalesce(F.when(d.rlike("^[3-6][0-9]{12,18}$"), _varied(d) & F.call_function("luhn_check", d)), F.lit(False))


def pis(value: Column) -> Column:
    d = digits(value)
    rest = 11 - _weighted(d, PIS_WEIGHTS) % 11
    return F.coalesce(F.when(F.length(d) == 11, _varied(d) & (F.when(rest >= 10, 0).otherwise(rest) == _at(d, 10))), F.lit(False))


VALIDATORS = {"cpf": cpf, "cnpj": cnpj, "cartao": card, "pis": pis}
