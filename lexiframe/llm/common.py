"""Helpers of the text-pipeline operators: free names, row keys, word lookups, parts of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.plans.shipping import ship

__all__ = ["Lookup", "chunks", "free", "parts_for", "row_key", "sample_places", "sample_texts", "ship", "text_of"]

HASH_PLACES = 1 << 40


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not use yet, whatever their case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id") -> Column:
    """128 bits of a row's id and text. Rows equal in both are one document and
    get the same decision, so a result joined back by this key multiplies nothing."""
    parts = [F.col(id_col).cast("string"), F.col(id_col).isNull(), text_of()]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many pieces of about `each` rows."""
    return max(least, -(-rows // each))


def sample_places(total: int, most: int) -> int:
    """How many of the `HASH_PLACES` hold about `most` of `total` texts."""
    return HASH_PLACES if total <= most else HASH_PLACES * most // total


def sample_texts(docs: DataFrame, most: int) -> DataFrame:
    """About `most` distinct texts, chosen by hash; all of them where there are no more."""
    texts = docs.select(text_of().alias("text"))
    total = texts.select(F.xxhash64("text").alias("hash")).distinct().count()
    place = F.pmod(F.xxhash64("text"), F.lit(HASH_PLACES))
    return texts.filter(place < F.lit(sample_places(total, most))).distinct()


class Lookup(dict):
    """word -> value of `make`; emptied when it holds `most` words, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def chunks(texts: list, most: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch with about `most` characters, one text at least."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
