"""Sentence pairs, fixed-width frames and shuffled batches."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.config import MODES
from lexiframe.functions import sequences as sq
from lexiframe.functions.hashing import key_digest, permuted
from lexiframe.plans.ranking import Level, global_rank, numbered

ROWS_PER_BUCKET = 100_000


def pair_sentences(indexed: DataFrame, mode: str, max_len: int) -> DataFrame:
    """Each sentence with itself or with the one after it in its document.

    The last sentence of a document makes no `next` pair.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    own = indexed.select("doc_id", "sent_id", sq.cut(F.col("ids"), max_len).alias("in_ids"))
    if mode == "self":
        return own.withColumn("out_ids", F.col("in_ids"))
    following = F.lead("in_ids").over(Window.partitionBy("doc_id").orderBy("sent_id"))
    return own.withColumn("out_ids", following).filter(F.col("out_ids").isNotNull())


def frame_pairs(pairs: DataFrame, max_len: int) -> DataFrame:
    source, output = F.col("in_ids"), F.col("out_ids")
    return pairs.select(
        "doc_id", "sent_id",
        sq.encoder_input(source, max_len).alias("in"),
        sq.decoder_input(output, max_len).alias("out"),
        sq.decoder_length(output, max_len).alias("out_len"),
        sq.decoder_target(output, max_len).alias("target"))


def framed_corpus(indexed: DataFrame, mode: str, max_len: int) -> DataFrame:
    return frame_pairs(pair_sentences(indexed, mode, max_len), max_len)


def sentence_matrix(indexed: DataFrame, max_len: int) -> DataFrame:
    """Padded rows of every sentence, the last one of a document included."""
    return indexed.select("doc_id", "sent_id",
                          sq.encoder_input(F.col("ids"), max_len).alias("in"))


def reversed_input(framed: DataFrame) -> DataFrame:
    """Encoder order: the sequence backwards, padding first."""
    return framed.withColumn("in", F.reverse("in"))


def hex_digits(n_rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """md5 digits that split the rows into buckets of about `per_bucket`, 1 to 5."""
    return min(5, max(1, ceil(log(max(n_rows, 1) / per_bucket, 16)))) if n_rows else 1


def digit_levels(digest: Column, digits: int) -> list[Level]:
    """Buckets by the first two md5 digits, split by the digits after them."""
    first = {"first": F.substring(digest, 1, min(digits, 2))}
    return [first] if digits <= 2 else [first, {"more": F.substring(digest, 3, digits - 2)}]


def shuffled_batches(rows: DataFrame, key: list[str], batch_size: int, epoch: int = 0,
                     seed: int = 1, drop_last: bool = False) -> DataFrame:
    """Add `batch_id`: a seeded global shuffle, redrawn each epoch, cut in batches.

    `rows` should be a written table: each epoch then re-reads it, and the two
    passes here read only the key for the bucket sizes.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    n_rows = rows.count()
    digest: Column = key_digest(seed, epoch, *[F.col(k) for k in key])
    keyed = rows.withColumn("_digest", digest)
    ranked = global_rank(
        keyed, digit_levels(F.col("_digest"), hex_digits(n_rows)),
        [F.col("_digest"), *[F.col(k) for k in key]])
    place = F.col("rank") - 1
    batched = ranked.select(
        *rows.columns, F.floor(place / batch_size).alias("batch_id"),
        (place % batch_size).cast("int").alias("row_in_batch"))
    return batched.filter(F.col("batch_id") < n_rows // batch_size) if drop_last else batched


def numbered_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their place under the key, made once for the orders of all epochs."""
    return numbered(rows, key)


def permuted_batches(rows: DataFrame, n_rows: int, batch_size: int, epoch: int = 0, seed: int = 1,
                     drop_last: bool = False) -> DataFrame:
    """Add `batch_id` and `row_in_batch`: each epoch's place of a row is a keyed permutation of its
    number. Nothing is sorted or moved; `rows` are `numbered_rows`, `n_rows` of them."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    place = rows.withColumn("place", F.explode(F.array(permuted(F.col("number"), n_rows, seed, epoch))))
    batched = place.select(*[c for c in rows.columns if c != "number"],
                           F.floor(F.col("place") / batch_size).alias("batch_id"),
                           (F.col("place") % batch_size).cast("int").alias("row_in_batch"))
    return batched.filter(F.col("batch_id") < n_rows // batch_size) if drop_last else batched
