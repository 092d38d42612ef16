"""Documents to sentences to words."""

from __future__ import annotations

from collections.abc import Iterable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.config import STOP_WORDS
from lexiframe.functions import text as tx
from lexiframe.functions.hashing import assign_split
from lexiframe.plans.layout import written

ABBREVIATION_SCORE = 0.3
PERIOD_OF_ABBREVIATION = 0.99  # share of its uses with a period
MOST_ABBREVIATIONS = 50_000

# Arrays are taken apart with the outer form of explode and a test for NULL. The
# inner form makes Spark add a filter on the array's size below the projection
# that builds the array, which would run its regular expressions twice.


def usable(text: str = "text") -> Column:
    return F.col(text).isNotNull()


def accepted(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.filter(usable(text))


def rejected(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.filter(~usable(text))


def label_documents(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Documents with their class as an int and a repeatable train/test split.

    The label table may be large, so the join is left to Spark's statistics.
    """
    classes = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return documents.join(classes, "doc_id").withColumn("split", assign_split(F.col("doc_id")))


def raw_sentences(documents: DataFrame, keep: Iterable[str] = (),
                  abbreviations: DataFrame | None = None) -> DataFrame:
    """Sentences of each text; with a table of `abbreviations` none is cut behind one of its words."""
    text = F.col("text")
    parts = tx.split_sentences(text) if abbreviations is None else tx.split_known(text, known_words(abbreviations))
    split = F.posexplode_outer(parts).alias("sent_id", "sentence")
    return accepted(documents).select("doc_id", *keep, split).filter(F.col("sentence").isNotNull())


def sentences(documents: DataFrame, remove_stopwords: bool = False,
              stop_words: Iterable[str] = STOP_WORDS, keep: Iterable[str] = ()) -> DataFrame:
    """One row per sentence with its words; a sentence without words stays, empty."""
    words = tx.word_list(F.col("sentence"), remove_stopwords, stop_words)
    return raw_sentences(documents, keep).select("doc_id", *keep, "sent_id", words.alias("words"))


def period_counts(documents: DataFrame) -> DataFrame:
    """`word, n_with, n_without`: how often a word stands with a single period behind it, and without."""
    tokens = F.explode_outer(F.transform(F.split("text", "[ \\t\\r\\n]+"), tx.period_type)).alias("token")
    seen = accepted(documents).select(tokens).select(
        F.rtrim("token", F.lit(".")).alias("word"), F.rlike("token", F.lit(r"[^.]\.\z")).alias("period"))
    return seen.filter(F.col("word") != "").groupBy("word").agg(
        F.count_if("period").alias("n_with"), F.count_if(~F.col("period")).alias("n_without"))


def abbreviations(documents: DataFrame, least: float = ABBREVIATION_SCORE) -> DataFrame:
    """`word, n_with, n_without, score` of the words that are abbreviations by the whole corpus.

    A word is one if its period goes with it far more often than with words at large: the
    log-likelihood ratio of "nearly always" against the share of periods behind any word, times a
    factor that falls with its letters, one that grows with its inner periods, and one that falls
    with each time it stands without a period (Kiss and Strunk, 2006).
    """
    counts = written(period_counts(documents), "period_counts")
    n_with, n_all = counts.agg(F.sum("n_with"), F.sum(F.col("n_with") + F.col("n_without"))).first()
    share = (n_with or 0) / (n_all or 1)
    if not 0 < share < 1:
        return counts.limit(0).withColumn("score", F.lit(0.0))
    a, b = F.col("n_with"), F.col("n_without")
    ratio = 2 * (a * F.lit(log(PERIOD_OF_ABBREVIATION)) + b * F.lit(log(1 - PERIOD_OF_ABBREVIATION))
                 - a * F.lit(log(share)) - b * F.lit(log(1 - share)))
    periods = F.length("word") - F.length(F.translate("word", ".", ""))
    letters = (F.length("word") - periods).cast("double")
    score = ratio * F.exp(-letters) * (periods + 1) * F.pow(letters, -b.cast("double"))
    plain = F.rlike("word", F.lit(r"^\p{L}[\p{L}.]*\z")) & (a > 0)
    return counts.filter(plain).withColumn("score", score).filter(F.col("score") >= least)


def known_words(table: DataFrame) -> list[str]:
    """The words of a table of abbreviations. A score falls by e with each letter, so only short
    and very frequent ones are there; more than `MOST_ABBREVIATIONS` are refused."""
    words = [r["word"] for r in table.select("word").distinct().limit(MOST_ABBREVIATIONS + 1).collect()]
    if len(words) > MOST_ABBREVIATIONS:
        raise ValueError(f"more than {MOST_ABBREVIATIONS} abbreviations: raise the least score")
    return words


def tokens(sents: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    each = F.posexplode_outer("words").alias("pos", "word")
    return sents.select("doc_id", *keep, "sent_id", each).filter(F.col("word").isNotNull())


def word_counts(sents: DataFrame) -> DataFrame:
    words = sents.select(F.explode_outer("words").alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def file_words(documents: DataFrame) -> DataFrame:
    """`file, word, cnt` of documents with the name of the file that holds them."""
    return tokens(sentences(documents, keep=["file"]), keep=["file"]).groupBy("file", "word").agg(
        F.count(F.lit(1)).alias("cnt"))


def corpus_size(sents: DataFrame) -> DataFrame:
    """Sentences, empty sentences and words in one pass."""
    n = F.size("words")
    return sents.agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum((n == 0).cast("long")).alias("n_empty"),
        F.sum(n.cast("long")).alias("n_words"),
    )
