"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the permutation of the Verhoeff scheme and the base-36 alphabet
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dihedral(j: int, k: int) -> int:
    """The product of two symmetries of a pentagon, numbered 0-4 for turns and 5-9 for flips."""
    if j < 5:
        return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
    return 5 + (j - k) % 5 if k < 5 else (j - k) % 5


def verhoeff_tables() -> tuple[list[int], list[int], list[int]]:
    """Products (10 x 10), permutation powers (8 x 10) and inverses (10), flat."""
    powers, row = [], list(range(10))
    for _ in range(8):
        powers += row
        row = [VERHOEFF_PERMUTATION[x] for x in row]
    products = [dihedral(j, k) for j in range(10) for k in range(10)]
    return products, powers, [next(k for k in range(10) if dihedral(j, k) == 0) for j in range(10)]


def _verhoeff(digits: Column, shift: int) -> Column:
    products, powers, _ = verhoeff_tables()
    d = F.array(*[F.lit(x) for x in products])
    p = F.array(*[F.lit(x) for x in powers])
    reverse = F.split(F.reverse(digits), "")
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def step(c: Column, i: Column) -> Column:
        digit = F.get(reverse, i).cast("int")
        return F.get(d, c * 10 + F.get(p, F.pmod(i + shift, F.lit(8)) * 10 + digit))

    return F.aggregate(places, F.lit(0), step)


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its Verhoeff check digit; false for anything else."""
    return F.when(digits.rlike("^[0-9]+$"), _verhoeff(digits, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(digits: Column) -> Column:
    """The digit that makes a string of digits valid."""
    inverse = F.array(*[F.lit(x) for x in verhoeff_tables()[2]])
    return F.when(digits.rlike("^[0-9]+$"), F.get(inverse, _verhoeff(digits, 1)))


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for anything else."""
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def gstin_check_char(stem: Column) -> Column:
    """The check character of a 14-character stem: base 36, weights 1 and 2 in turn, 2 for the last."""
    alphabet = F.lit(BASE36)
    chars = F.split(F.reverse(F.upper(stem)), "")

    def step(total: Column, i: Column) -> Column:
        product = (F.instr(alphabet, F.get(chars, i)) - 1) * (F.lit(2) - F.pmod(i, F.lit(2)))
        return total + F.floor(product / 36).cast("int") + F.pmod(product, F.lit(36))

    total = F.aggregate(F.sequence(F.lit(0), F.length(stem) - 1), F.lit(0), step)
    return F.substring(alphabet, F.pmod(F.lit(36) - F.pmod(total, F.lit(36)), F.lit(36)) + 1, F.lit(1))
