"""Vocabulary, word ids and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.config import SPECIAL_WORDS, UNK
from lexiframe.plans.lookup import BROADCAST_BYTES, lookup
from lexiframe.plans.ranking import Level, global_rank

HOT_WORD_BYTES = 64


def min_count(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= least)


EXACT_COUNTS = 1024


def rank_levels() -> list[Level]:
    """Coarse keys in vocabulary order: some two thousand classes of counts, then
    the first two letters.

    Low counts, which most words have, get a class each, split by the letters.
    Higher counts share 16 classes per doubling, ranked inside.
    """
    low = F.col("cnt") < EXACT_COUNTS
    shared = EXACT_COUNTS + F.floor(F.log2(F.col("cnt") / F.lit(float(EXACT_COUNTS))) * 16)
    return [{"count_class": F.when(low, F.col("cnt")).otherwise(shared).cast("int")},
            {"letters": F.when(low, F.substring("word", 1, 2)).otherwise("")}]


def special_words(counts: DataFrame) -> DataFrame:
    spark = counts.sparkSession
    rows = [(i, w, None) for i, w in enumerate(SPECIAL_WORDS)]
    return spark.createDataFrame(rows, "id int, word string, cnt long")


def build_vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """`id, word, cnt`: special words first, then by falling count and word."""
    ranked = global_rank(
        min_count(counts, least), rank_levels(),
        [F.col("cnt").desc(), F.col("word").asc()], descending=["count_class"])
    ids = (F.col("rank") + (len(SPECIAL_WORDS) - 1)).cast("int").alias("id")
    return special_words(counts).unionByName(ranked.select(ids, "word", "cnt"))


def hot_words(n: int) -> Column:
    """The n first, so most frequent, ids, but for the odd overlong word."""
    return hot_ids(n) & (F.octet_length("word") <= HOT_WORD_BYTES)


def hot_ids(n: int) -> Column:
    return F.col("id") < n


def real_words(vocabulary: DataFrame) -> DataFrame:
    """Without the special symbols (a cleaned word never equals one)."""
    return vocabulary.filter(F.col("cnt").isNotNull())


def word_ids(toks: DataFrame, vocabulary: DataFrame, unknown: int | None = UNK,
             limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add `id`; a word outside the vocabulary gets `unknown`, or goes if None."""
    table = real_words(vocabulary).select("word", "id")
    found = lookup(toks, table, "word", hot_words, limit, "doc_id")
    if unknown is None:
        return found.filter(F.col("id").isNotNull())
    return found.withColumn("id", F.coalesce("id", F.lit(unknown)))


ID_BITS = 32


def place_and_id() -> Column:
    """Position and id in one long: collected and sorted as plain numbers."""
    return F.shiftleft(F.col("pos").cast("long"), ID_BITS) + F.col("id")


def ids_in_order(places: Column) -> Column:
    low = F.lit(2**ID_BITS - 1)
    return F.transform(F.sort_array(places), lambda x: x.bitwiseAND(low).cast("int"))


def index_sentences(sents: DataFrame, vocabulary: DataFrame, unknown: int | None = UNK,
                    limit: int = BROADCAST_BYTES) -> DataFrame:
    """`doc_id, sent_id, ids` for every sentence, also the empty ones.

    With the sentences clustered by document and a broadcast vocabulary, the
    regrouping finds each sentence where it already lies: no shuffle.
    """
    toks = sents.select("doc_id", "sent_id", F.posexplode_outer("words").alias("pos", "word"))
    table = real_words(vocabulary).select("word", "id")
    found = lookup(toks, table, "word", hot_words, limit, "doc_id")
    if unknown is not None:
        found = found.withColumn("id", F.coalesce("id", F.lit(unknown)))
    place = F.when(F.col("word").isNotNull(), place_and_id())
    grouped = found.groupBy("doc_id", "sent_id").agg(F.collect_list(place).alias("places"))
    return grouped.select("doc_id", "sent_id", ids_in_order(F.col("places")).alias("ids"))


def decode_sentences(indexed: DataFrame, vocabulary: DataFrame,
                     limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ids back to text, unknown words shown as their symbol."""
    toks = indexed.select("doc_id", "sent_id", F.posexplode_outer("ids").alias("pos", "id"))
    found = lookup(toks, vocabulary.select("id", "word"), "id", hot_ids, limit, "doc_id")
    item = F.when(F.col("word").isNotNull(), F.struct("pos", "word"))
    grouped = found.groupBy("doc_id", "sent_id").agg(F.collect_list(item).alias("items"))
    words = F.transform(F.sort_array("items"), lambda x: x["word"])
    return grouped.select("doc_id", "sent_id", F.array_join(words, " ").alias("sentence"))


def unknown_rate(toks_with_id: DataFrame, by: Iterable[str]) -> DataFrame:
    missing = (F.col("id") == UNK).cast("long")
    return toks_with_id.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(missing).alias("n_unknown"),
        F.round(F.avg(missing), 6).alias("unknown_rate"))
