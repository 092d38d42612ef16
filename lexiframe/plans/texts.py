"""Registered queries over documents: sentences to framed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.config import Settings
from lexiframe.functions import sequences as sq
from lexiframe.functions import text as tx
from lexiframe.operators import corpus, framing, vocabulary
from lexiframe.plans import ranking
from lexiframe.plans.layout import cluster, new_path, shared_folder, spread, written
from lexiframe.sources import corpus as source
from lexiframe.sources.artefacts import code_identity, input_identity, reuse_or_write
from lexiframe.sources.tables import table

SETTINGS = Settings()


def documents(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", *extra)


def counted_words(spark: SparkSession, folder: str, remove_stopwords: bool = False) -> DataFrame:
    docs = spread(documents(spark, folder), "doc_id")
    return corpus.word_counts(corpus.sentences(docs, remove_stopwords))


def saved_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of every word of the corpus, stop words included.

    Kept in the shared folder: one pass over the texts serves every later query
    on the same files.
    """
    return reuse_or_write(
        spark, f"{shared_folder(spark)}/lexiframe/kept", "vocabulary", SETTINGS,
        (input_identity(spark, [f"{folder}/documents.parquet"]),
         code_identity(tx, corpus, vocabulary, ranking)),
        lambda: vocabulary.build_vocabulary(counted_words(spark, folder), SETTINGS.min_count))


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed sentences without stop words, clustered by document."""
    docs = cluster(documents(spark, folder), "doc_id")
    sents = corpus.sentences(docs, remove_stopwords=True)
    return vocabulary.index_sentences(sents, saved_vocabulary(spark, folder))


def joined(array: str) -> F.Column:
    return F.array_join(array, " ").alias(array)


def raw_sentences(spark, folder):
    return corpus.raw_sentences(spread(documents(spark, folder), "doc_id"))


def sentence_tokens(spark, folder):
    return corpus.tokens(corpus.sentences(spread(documents(spark, folder), "doc_id")))


def tokens_no_stop(spark, folder):
    docs = spread(documents(spark, folder), "doc_id")
    return corpus.tokens(corpus.sentences(docs, remove_stopwords=True))


def document_status(spark, folder):
    """Documents kept, rejected and blank, by source, in one pass."""
    return documents(spark, folder, "source").groupBy("source").agg(
        F.count_if(corpus.usable()).alias("n_kept"),
        F.count_if(~corpus.usable()).alias("n_rejected"),
        F.count_if(F.trim("text") == "").alias("n_blank"))


def labelled_corpus(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return corpus.label_documents(docs, table(spark, folder, "labels"), "quality")


def word_counts(spark, folder):
    return counted_words(spark, folder)


def vocab_min20(spark, folder):
    return vocabulary.build_vocabulary(counted_words(spark, folder), SETTINGS.min_count)


def corpus_size(spark, folder):
    """Sentences, words and vocabulary size."""
    docs = spread(documents(spark, folder), "doc_id")
    size = corpus.corpus_size(corpus.sentences(docs))
    vocab = saved_vocabulary(spark, folder)
    return size.withColumn("vocab_size", F.lit(vocab.count()))


def token_ids(spark, folder):
    docs = spread(documents(spark, folder), "doc_id")
    toks = corpus.tokens(corpus.sentences(docs, remove_stopwords=True))
    return vocabulary.word_ids(toks, saved_vocabulary(spark, folder)).select(
        "doc_id", "sent_id", "pos", "id")


def oov_rate_by_lang(spark, folder):
    docs = spread(documents(spark, folder, "lang"), "doc_id")
    toks = corpus.tokens(corpus.sentences(docs, True, keep=["lang"]), keep=["lang"])
    ids = vocabulary.word_ids(toks, saved_vocabulary(spark, folder))
    return vocabulary.unknown_rate(ids, ["lang"])


def decoded_sentences(spark, folder):
    vocab = saved_vocabulary(spark, folder)
    docs = cluster(documents(spark, folder), "doc_id")
    ids = vocabulary.index_sentences(corpus.sentences(docs, remove_stopwords=True), vocab)
    return vocabulary.decode_sentences(ids, vocab)


def _pairs(spark, folder, mode):
    pairs = framing.pair_sentences(indexed(spark, folder), mode, SETTINGS.max_len)
    return pairs.select("doc_id", "sent_id", joined("in_ids"), joined("out_ids"))


def self_pairs(spark, folder):
    return _pairs(spark, folder, "self")


def next_pairs(spark, folder):
    return _pairs(spark, folder, "next")


def framed(spark, folder, mode=SETTINGS.mode):
    return framing.framed_corpus(indexed(spark, folder), mode, SETTINGS.max_len)


def _shown(frames: DataFrame) -> DataFrame:
    return frames.select("doc_id", "sent_id", joined("in"), joined("out"), "out_len",
                         joined("target"))


def pair_frames(spark, folder):
    return _shown(framed(spark, folder, "next"))


def self_frames(spark, folder):
    return _shown(framed(spark, folder, "self"))


def pair_mask(spark, folder):
    width = SETTINGS.max_len + 1
    mask = sq.length_mask(F.col("out_len"), width)
    frames = framed(spark, folder).withColumn("mask", mask)
    return frames.select("doc_id", "sent_id", "out_len", joined("mask"))


def reversed_inputs(spark, folder):
    frames = framing.reversed_input(framed(spark, folder))
    last = sq.last_step(F.col("in")).alias("last_id")
    return frames.select("doc_id", "sent_id", joined("in"), last)


def sentence_matrix(spark, folder):
    rows = framing.sentence_matrix(indexed(spark, folder), SETTINGS.max_len)
    return rows.select("doc_id", "sent_id", joined("in"))


def _batched(spark, folder, drop_last=False, epoch=0):
    frames = written(framed(spark, folder).select("doc_id", "sent_id", "out_len"), "framed_keys")
    return framing.shuffled_batches(frames, ["doc_id", "sent_id"], SETTINGS.batch_size,
                                    epoch=epoch, seed=SETTINGS.seed, drop_last=drop_last)


def shuffled_batches(spark, folder):
    return _batched(spark, folder).select(
        "doc_id", "sent_id", "out_len", "batch_id", "row_in_batch")


def full_batches(spark, folder):
    """Second epoch's order, without the short last batch."""
    return _batched(spark, folder, drop_last=True, epoch=1).select(
        "doc_id", "sent_id", "batch_id", "row_in_batch")


def permuted_batches(spark, folder):
    """The second epoch's batches by a permutation of row numbers."""
    frames = written(framed(spark, folder).select("doc_id", "sent_id"), "framed_keys")
    rows = framing.numbered_rows(frames, ["doc_id", "sent_id"])
    return framing.permuted_batches(rows, frames.count(), SETTINGS.batch_size, epoch=1, seed=SETTINGS.seed)


def abbreviations(spark, folder):
    """Words that the corpus shows to be abbreviations, with their counts and scores."""
    found = corpus.abbreviations(spread(documents(spark, folder), "doc_id"))
    return found.withColumn("score", F.round("score", 6))


def split_sentences(spark, folder):
    """Sentences that are not cut behind an abbreviation of the corpus."""
    docs = spread(documents(spark, folder), "doc_id")
    return corpus.raw_sentences(docs, abbreviations=corpus.abbreviations(docs))


def quoted_corpus(spark, folder):
    """Documents written as quoted fields, a line per sentence, and read back by many tasks."""
    path = new_path(spark, "quoted_corpus")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    source.write_corpus(documents(spark, folder).select(F.col("doc_id").alias("label"), text.alias("text")), path)
    rows = source.good_rows(source.read_corpus(spark, path, "train"))
    return rows.select("split", F.col("label").alias("doc_id"), F.size(F.split("text", "\n")).alias("n_lines"),
                       F.md5("text").alias("digest"))


def batch_stats(spark, folder):
    return _batched(spark, folder).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("out_len").alias("n_targets"),
        F.max("out_len").alias("longest"))


QUERIES = {
    f.__name__: f for f in (
        document_status, labelled_corpus, raw_sentences, sentence_tokens, word_counts,
        vocab_min20, corpus_size, tokens_no_stop, token_ids, oov_rate_by_lang,
        decoded_sentences, self_pairs, next_pairs, pair_frames, self_frames, pair_mask,
        reversed_inputs, sentence_matrix, shuffled_batches, full_batches, batch_stats,
        permuted_batches, abbreviations, split_sentences, quoted_corpus)
}
