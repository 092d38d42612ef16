"""Column expressions for character sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.config import CHAR_END, CHAR_PAD, CHAR_START, LETTERS

DEFAULT_ALPHABET = CHAR_START + CHAR_END + CHAR_PAD + LETTERS


def split_chars(text: Column) -> Column:
    """One array element per code point (an empty-pattern split would cut
    characters outside the basic plane in two)."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def char_ids(text: Column, alphabet: str = DEFAULT_ALPHABET) -> Column:
    """Position of each character in the alphabet, -1 where it is not in it.

    An alphabet is a short constant, so the lookup stays inside the row.
    """
    symbols = F.lit(list(alphabet))
    return F.transform(split_chars(text),
                       lambda c: (F.array_position(symbols, c) - 1).cast("int"))


def decode_chars(ids: Column, alphabet: str = DEFAULT_ALPHABET) -> Column:
    symbols = F.lit(list(alphabet))
    return F.array_join(F.transform(ids, lambda i: F.try_element_at(symbols, i + 1)), "")


def char_output(text: Column) -> Column:
    return F.concat(F.lit(CHAR_START), text)


def char_target(text: Column) -> Column:
    return F.concat(text, F.lit(CHAR_END))


def char_filler(text: Column) -> Column:
    return F.repeat(F.lit(CHAR_PAD), F.char_length(text))


def before_end(decoded: Column) -> Column:
    """Text before the first end symbol, the whole text where there is none."""
    return F.substring_index(decoded, CHAR_END, 1)


def has_end(decoded: Column) -> Column:
    return F.instr(decoded, CHAR_END) > 0


def rewrite_as_chars(text: Column) -> Column:
    """Characters of a line with spaces shown as `_`."""
    return split_chars(F.translate(text, " ", "_"))
