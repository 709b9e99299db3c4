"""Turkish tax numbers: their check digits and what an extracted value is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_tax_id(c: Column) -> Column:
    """Digits of a value that has but digits and separators, else null."""
    bare = F.regexp_replace(c, r"[\s./_-]", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def _digit(c: Column, place: int) -> Column:
    return F.substring(c, place + 1, 1).cast("int")


def is_valid_vkn(c: Column) -> Column:
    """10 digits: each of the first nine, moved by its place, weighs a power of two modulo 9."""

    def part(i: int) -> Column:
        moved = (_digit(c, i) + (9 - i)) % 10
        rest = (moved * (2 ** (9 - i))) % 9
        return F.when(moved == 0, 0).when(rest == 0, 9).otherwise(rest)

    total = sum((part(i) for i in range(1, 9)), part(0))
    return F.coalesce(F.when(c.rlike("^[0-9]{10}$"), _digit(c, 9) == (10 - total % 10) % 10), F.lit(False))


def is_valid_tckn(c: Column) -> Column:
    """11 digits, the first not 0, the last two from sums of the others."""
    odd = sum((_digit(c, i) for i in range(2, 9, 2)), _digit(c, 0))
    even = sum((_digit(c, i) for i in range(3, 9, 2)), _digit(c, 1))
    ten, eleven = F.pmod(odd * 7 - even, F.lit(10)), (odd + even + _digit(c, 9)) % 10
    return F.coalesce(F.when(c.rlike("^[1-9][0-9]{10}$"), (_digit(c, 9) == ten) & (_digit(c, 10) == eleven)), F.lit(False))


def classify_tax_id(c: Column) -> Column:
    """struct<kind, normalized, valid>: valid is null where the number can't be judged. The number is
    normalised once, in an array of one."""

    def of(norm: Column) -> Column:
        n, inside = F.length(norm), F.regexp_extract(c, r"(?<![0-9])([0-9]{10,11})(?![0-9])", 1)
        labelled = norm.isNull() & F.contains(F.trim(c), F.lit(" ")) & (inside != "")
        kind = F.when(labelled, "label_captured").when(norm.isNull(), "not_numeric").when(n == 10, "vkn").when(n == 11, "tckn").otherwise("unknown_length")
        valid = F.when(n == 10, is_valid_vkn(norm)).when(n == 11, is_valid_tckn(norm))
        return F.struct(kind.alias("kind"), F.when(labelled, inside).otherwise(norm).alias("normalized"), valid.alias("valid"))

    return F.get(F.transform(F.array(normalize_tax_id(c)), of), 0)
