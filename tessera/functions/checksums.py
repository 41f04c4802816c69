"""Check digits as Spark columns. Input is text; everything but letters and digits is ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Spanish DNI, characters of ISO 7064 mod 11-2.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
MOD11_2 = "10X98765432"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def numerals(c: Column) -> Column:
    """The digits as an array of ints."""
    return F.transform(F.filter(F.split(digits(c), ""), lambda x: x != ""), lambda x: x.cast("int"))


def luhn_digit(body: Column) -> Column:
    """The digit that makes a number valid under Luhn."""
    rev = F.reverse(numerals(body))
    doubled = F.transform(rev, lambda x, i: F.when(i % 2 == 0, F.when(2 * x > 9, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def luhn_valid(full: Column) -> Column:
    d = digits(full)
    return (F.length(d) > 1) & (luhn_digit(F.left(d, F.length(d) - 1)) == F.right(d, F.lit(1)))


def _dihedral() -> tuple[list[int], list[int], list[int]]:
    """Verhoeff's tables from their rules: products in the dihedral group of ten, powers of one permutation, inverses."""
    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    d = [product(a, b) for a in range(10) for b in range(10)]
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value: Verhoeff's permutation
    powers, row = [], list(range(10))
    for _ in range(8):
        powers += row
        row = [turn[r] for r in row]
    inverse = [next(b for b in range(10) if product(a, b) == 0) for a in range(10)]
    return d, powers, inverse


def _verhoeff_state(c: Column, offset: int) -> Column:
    d, powers, _ = _dihedral()
    table, turns = F.array(*[F.lit(x) for x in d]), F.array(*[F.lit(x) for x in powers])
    indexed = F.transform(F.reverse(numerals(c)), lambda x, i: F.element_at(turns, (((i + offset) % 8) * 10 + x + 1).cast("int")))
    return F.aggregate(indexed, F.lit(0), lambda acc, x: F.element_at(table, (acc * 10 + x + 1).cast("int")))


def verhoeff_digit(body: Column) -> Column:
    _, _, inverse = _dihedral()
    return F.element_at(F.array(*[F.lit(x) for x in inverse]), (_verhoeff_state(body, 1) + 1).cast("int")).cast("string")


def verhoeff_valid(full: Column) -> Column:
    return (F.length(digits(full)) > 1) & (_verhoeff_state(full, 0) == 0)


def dni_letter(body: Column) -> Column:
    return F.substr(F.lit(DNI_LETTERS), (digits(body).try_cast("long") % 23 + 1).cast("int"), F.lit(1))


def dni_valid(full: Column) -> Column:
    b = bare(full)
    return F.coalesce(b.rlike("^[0-9]{8}[A-Z]$") & (dni_letter(b) == F.right(b, F.lit(1))), F.lit(False))


def insee_key(body: Column) -> Column:
    return F.lpad((97 - digits(body).try_cast("decimal(20,0)") % 97).cast("int").cast("string"), 2, "0")


def insee_valid(full: Column) -> Column:
    b = bare(full)
    return F.coalesce(b.rlike("^[0-9]{15}$") & (insee_key(F.left(b, F.lit(13))) == F.right(b, F.lit(2))), F.lit(False))


def iso7064_digit(body: Column) -> Column:
    """ISO 7064 mod 11-2, as in Chinese identity numbers."""
    n = numerals(body)
    total = F.aggregate(n, F.lit(0), lambda acc, x: ((acc + x) * 2) % 11)
    return F.substr(F.lit(MOD11_2), total.cast("int") + 1, F.lit(1))


def iso7064_valid(full: Column) -> Column:
    b = bare(full)
    return F.coalesce((F.length(b) > 1) & (iso7064_digit(F.left(b, F.length(b) - 1)) == F.right(b, F.lit(1))), F.lit(False))


COMPUTE = {"luhn": luhn_digit, "verhoeff": verhoeff_digit, "dni": dni_letter, "insee": insee_key, "iso7064": iso7064_digit}
VALID = {"luhn": luhn_valid, "verhoeff": verhoeff_valid, "dni": dni_valid, "insee": insee_valid, "iso7064": iso7064_valid}


def valid(algorithm: str, full: Column) -> Column:
    """Whether ``full`` ends in its check digit; false for NULL."""
    return F.coalesce(VALID[algorithm](full), F.lit(False))
