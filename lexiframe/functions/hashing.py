"""Random-looking but repeatable choices, from md5."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by `|`; bare strings and numbers are literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 1) with 24 bits, fixed by the parts."""
    head = F.conv(F.substring(key_digest(*parts), 1, 6), 16, 10).cast("long")
    return head / F.lit(float(16**6))


def assign_split(doc_id: Column, test_digits: str = "0") -> Column:
    """`test` where the md5 of the id starts with one of the digits, else `train`."""
    first = F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1)
    return F.when(first.isin(*test_digits), "test").otherwise("train")


FEISTEL_ROUNDS = 6
WALKS = 64


def feistel_sides(n: int) -> tuple[int, int]:
    """Two numbers near the square root of n whose product is n or just above."""
    rows = max(1, isqrt(max(n, 1) - 1) + 1)
    return rows, max(1, -(-n // rows))


def permuted(number: Column, n: int, *key: str | int) -> Column:
    """A keyed permutation of 0 .. n - 1, from arithmetic on each number alone.

    A number is a row and a column of a grid of about n cells. Rounds in turn move the row by a
    hash of the column and the column by a hash of the row, which can be undone, so no two numbers
    meet. The few cells beyond n (a part of one in the root of n) are walked on until one is below.
    """
    rows, columns = feistel_sides(n)

    def moved(turn: Column, side: Column) -> Column:
        return F.conv(F.substring(key_digest(*key, turn, side), 1, 8), 16, 10).cast("long")

    def once(cell: Column) -> Column:
        start = F.struct(F.floor(cell / columns).alias("row"), (cell % columns).alias("column"))
        end = F.aggregate(
            F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), start, lambda at, turn: F.when(
                turn % 2 == 0, F.struct(((at["row"] + moved(turn, at["column"])) % rows).alias("row"),
                                        at["column"].alias("column"))).otherwise(
                F.struct(at["row"].alias("row"), ((at["column"] + moved(turn, at["row"])) % columns).alias("column"))),
            lambda at: at["row"] * columns + at["column"])
        return end

    def walk(cell: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALKS))
        return F.aggregate(steps, cell, lambda at, _: F.when(at < n, at).otherwise(once(at)),
                           lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("no place found")).cast("long")))

    whole = number.cast("long")
    return whole if n < 2 else walk(once(whole))
