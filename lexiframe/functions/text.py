"""Column expressions that clean and split text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.config import STOP_WORDS

BLANKS = " \t\r\n"
# Blanks that follow a sentence end; the end itself stays with its sentence.
BETWEEN_SENTENCES = r"(?<=[.!?])[ \t\r\n]+"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_sentences(text: Column) -> Column:
    """Raw sentences of a text; a blank text has none."""
    return F.array_remove(F.split(strip_blanks(text), BETWEEN_SENTENCES), "")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z]", " ")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), " +"), "")


def drop_stop_words(words: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Drop stop words and one-letter words."""
    stops = sorted(set(stop_words))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stops))


def word_list(text: Column, remove_stopwords: bool = False,
              stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case English-letter words of a text, in order.

    `split_words(letters_only(text))` in one pass. Words are lowered only once cut
    out: a few other letters turn into English ones when lowered.
    """
    words = F.array_remove(F.transform(F.split(text, "[^a-zA-Z]+"), F.lower), "")
    return drop_stop_words(words, stop_words) if remove_stopwords else words


def sentence_words(text: Column, remove_stopwords: bool = False,
                   stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Nested view: one word array per raw sentence, empty ones kept."""
    return F.transform(split_sentences(text),
                       lambda s: word_list(s, remove_stopwords, stop_words))


MARK = "\u0001"  # between sentences; a text's own ones count as blanks


def period_type(token: Column) -> Column:
    """A token in lower case without marks around it; its periods stay."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}]+|[^\p{L}.]+$", "")


def last_token(text: Column) -> Column:
    return F.regexp_extract(text, r"([^ \t\r\n]*)[ \t\r\n]*\z", 1)


def ends_in(text: Column, abbreviations: Iterable[str]) -> Column:
    """Whether a text's last token is one of the abbreviations and its one final period."""
    words = sorted(abbreviations)
    if not words:
        return F.lit(False)
    return period_type(last_token(text)).isin([f"{w}." for w in words])


def split_known(text: Column, abbreviations: Iterable[str]) -> Column:
    """Raw sentences of a text that is not cut behind an abbreviation.

    The text is cut behind every sentence end, and the marks between the parts are left out
    behind abbreviations: one pass each, however many parts there are.
    """
    body = strip_blanks(F.translate(text, MARK, " "))
    parts = F.split(F.regexp_replace(body, r"([.!?][ \t\r\n]+)", f"$1{MARK}"), MARK)
    kept = F.transform(parts, lambda p: F.concat(p, F.when(ends_in(p, abbreviations), "").otherwise(MARK)))
    return F.array_remove(F.transform(F.split(F.array_join(kept, ""), MARK), strip_blanks), "")
