"""The three usual runs, end to end, from corpus files to a report table.

1. `train_words`: corpus -> sentences -> down-sampled words -> unit word vectors.
2. `frame_corpus` and `export_vectors`: clean, index, frame; pool vectors per document.
3. `score_exports`: fit and score what has no report yet; reports and flat table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.config import Settings
from lexiframe.functions import names
from lexiframe.operators import (corpus, experiments, framing, scoring, skipgram, vectors,
                                 vocabulary)
from lexiframe.plans.layout import cluster, spread, timed, written
from lexiframe.sources import corpus as source
from lexiframe.sources import reports, vectors as store
from lexiframe.sources.artefacts import code_identity, exists, input_identity, reuse_or_write


def ingest(spark: SparkSession, paths: dict[str, str], folder: str,
           settings: Settings = Settings(), multiline: bool = True) -> DataFrame:
    """`split, label, text, doc_id` of the corpus files, kept with fixed ids.

    Rows that do not parse are kept beside it, see `rejects`. With `multiline` a field
    may hold line ends, and text moves once; without it text stays where it is read.
    """
    return _kept(spark, paths, folder, settings, multiline, "corpus", source.good_rows, source.with_doc_id)


def rejects(spark: SparkSession, paths: dict[str, str], folder: str,
            settings: Settings = Settings(), multiline: bool = True) -> DataFrame:
    """The rows of the corpus files that do not parse, with their split."""
    return _kept(spark, paths, folder, settings, multiline, "rejects", source.bad_rows, lambda rows: rows)


def _kept(spark, paths, folder, settings, multiline, name, choose, finish) -> DataFrame:
    def make() -> DataFrame:
        parts = [choose(source.read_corpus(spark, path, split, multiline=multiline))
                 for split, path in paths.items()]
        return finish(reduce(DataFrame.unionByName, parts))

    identity = input_identity(spark, list(paths.values()))
    with timed(name):
        return reuse_or_write(spark, folder, name, settings,
                              (sorted(paths.items()), identity, code_identity(source), multiline), make)


def build_vocabulary(documents: DataFrame, settings: Settings = Settings(),
                     folder: str | None = None) -> DataFrame:
    """A written vocabulary of all words, stop words included.

    With a `folder` it is kept there, and made again only for other files, settings or code.
    """
    def make() -> DataFrame:
        counts = corpus.word_counts(corpus.sentences(spread(documents, "doc_id")))
        return vocabulary.build_vocabulary(counts, settings.min_count)

    with timed("vocabulary"):
        if folder is None:
            return written(make(), "vocabulary")
        spark = documents.sparkSession
        return reuse_or_write(spark, folder, "vocabulary", settings,
                              (input_identity(spark, documents.inputFiles()),
                               code_identity(corpus, vocabulary)), make)


def train_words(documents: DataFrame, vocab: DataFrame, folder: str, size: int,
                settings: Settings = Settings(), iterations: int = 25) -> str:
    """Fit and store unit word vectors; returns their path."""
    with timed("word vectors"):
        toks = corpus.tokens(corpus.sentences(cluster(documents, "doc_id")))
        kept = skipgram.regroup(skipgram.subsample(toks, vocab, settings.sample))
        model = vectors.fit_word_vectors(written(kept, "kept_sentences"), size, settings, iterations)
        return store.write_word_vectors(vectors.unit_word_vectors(model), folder, size, settings)


def index_corpus(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    sents = corpus.sentences(cluster(documents, "doc_id"), remove_stopwords=True)
    return vocabulary.index_sentences(sents, vocab)


def frame_corpus(documents: DataFrame, vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Framed pairs as a written table, to be shuffled anew for each epoch."""
    with timed("frames"):
        framed = framing.framed_corpus(index_corpus(documents, vocab), settings.mode, settings.max_len)
        return written(framed, "framed_corpus")


def epoch_batches(framed: DataFrame, epoch: int, settings: Settings = Settings()) -> DataFrame:
    """One epoch's batches in encoder order."""
    batched = framing.shuffled_batches(framed, ["doc_id", "sent_id"], settings.batch_size,
                                       epoch, settings.seed)
    return framing.reversed_input(batched)


def export_vectors(documents: DataFrame, vocab: DataFrame, word_vectors: DataFrame,
                   experiment: str, path: str) -> None:
    """One pooled vector per document, stored per experiment and split."""
    with timed(f"vectors of {experiment}"):
        by_id = written(vocab.join(word_vectors, "word").select("id", "vector"), "id_vectors")
        pooled = vectors.document_vectors(documents, index_corpus(documents, vocab), by_id)
        splits = documents.select("doc_id", "split")
        store.write_vectors(pooled.join(splits, "doc_id").withColumn("experiment", F.lit(experiment)),
                            path)


def experiment_name(spark: SparkSession, settings: Settings, cell: str, direction: str, units: int,
                    layers: int, epoch: int, run_time: int | None = None) -> str:
    """The name an export is stored under; `run_time` defaults to now."""
    model = names.model_name(
        *[F.lit(v) for v in (settings.mode, cell, direction, settings.batch_size,
                             settings.max_len, units, layers)])
    name = names.experiment_name(model, F.lit(epoch), names.run_id(run_time))
    return spark.range(1).select(name).first()[0]


def score_exports(documents: DataFrame, vectors_path: str, reports_path: str, table_path: str,
                  n_classes: int, run_time: int | None = None, **options) -> DataFrame:
    """Score pending experiments, then write the flat table of all reports.

    The table goes into a folder of its own under `table_path`, named after the run's
    time; a time that was used before is refused before anything is fitted.
    """
    spark = documents.sparkSession
    run = spark.range(1).select(names.run_id(run_time)).first()[0]
    table_path = f"{table_path}/run={run}"
    if exists(spark, table_path):
        raise FileExistsError(table_path)
    labels = documents.select("doc_id", "label")
    with timed("scores"):
        scored = scoring.score_pending(spark, vectors_path, labels, reports_path, n_classes, **options)
        table = experiments.report_table(scored)
        reports.write_table(table, table_path)
    return table
