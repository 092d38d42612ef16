"""Registered queries over contexts, vectors and likelihood."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.functions.hashing import assign_split
from lexiframe.operators import bigram, corpus, factors, skipgram, skipgram_model, vectors, vocabulary
from lexiframe.operators.skipgram_model import fit_skip_gram
from lexiframe.plans.layout import cluster, shared_folder, spread, written
from lexiframe.plans.texts import SETTINGS, documents, framed, saved_vocabulary
from lexiframe.sources.artefacts import code_identity, input_identity, reuse_or_write
from lexiframe.sources.tables import table

SMOOTHING = 0.1
VECTOR_SIZE = 100
EPOCHS = 25
FACTORS = 20


def kept_tokens(spark, folder, vocab, place=cluster):
    docs = place(documents(spark, folder), "doc_id")
    toks = corpus.tokens(corpus.sentences(docs))
    return skipgram.subsample(toks, vocab, SETTINGS.sample)


def subsampled_tokens(spark, folder):
    return kept_tokens(spark, folder, saved_vocabulary(spark, folder), spread).select(
        "doc_id", "sent_id", "pos", "word")


def pair_rows(spark, folder):
    return skipgram.pair_counts(
        kept_tokens(spark, folder, saved_vocabulary(spark, folder)), SETTINGS.window)


def skipgram_pairs(spark, folder):
    return pair_rows(spark, folder)


def noise_distribution(spark, folder):
    noise = skipgram.noise_distribution(saved_vocabulary(spark, folder))
    return noise.withColumn("prob", F.round("prob", 9))


def negative_samples(spark, folder):
    """The noise words of every pair, in order of their draws."""
    drawn = skipgram.noise_lists(pair_rows(spark, folder), saved_vocabulary(spark, folder), SETTINGS.negative)
    return drawn.select("center", "context", F.array_join("noise", " ").alias("noise"))


def trained_words(spark, folder):
    """`id, vector, loss_falls` of one training run, kept for the queries that read it."""
    def make():
        model = fit_skip_gram(pair_rows(spark, folder), saved_vocabulary(spark, folder), VECTOR_SIZE,
                              SETTINGS.negative, EPOCHS)
        falls = all(b < a for a, b in zip(model.losses, model.losses[1:]))
        return model.vectors.withColumn("loss_falls", F.lit(falls))

    return reuse_or_write(spark, f"{shared_folder(spark)}/lexiframe/kept", "trained_words", SETTINGS,
                          (input_identity(spark, [f"{folder}/documents.parquet"]),
                           code_identity(skipgram, skipgram_model, corpus, vocabulary), EPOCHS, VECTOR_SIZE), make)


def sgns_vectors(spark, folder):
    """Word vectors trained with negative sampling: each id's width, and whether the loss fell in every epoch."""
    return trained_words(spark, folder).select("id", F.size("vector").alias("width"), "loss_falls")


def sppmi(spark, folder):
    return _cells(spark, folder).withColumn("sppmi", F.round("sppmi", 6))


def _cells(spark, folder):
    kept = kept_tokens(spark, folder, saved_vocabulary(spark, folder))
    half = written(skipgram.half_counts(kept, SETTINGS.window), "skipgram_pairs")
    return skipgram.shifted_ppmi(half, SETTINGS.negative)


def sppmi_vectors(spark, folder):
    """Word vectors factorised from the cells, a block of rows at a time: each id's width."""
    factors = vectors.factor_vectors(written(_cells(spark, folder), "sppmi"), VECTOR_SIZE)
    return factors.select("id", F.size("vector").alias("width"))


def kept_cells(spark, folder):
    """The cells above zero, written for the many products of a factorisation."""
    return written(_cells(spark, folder).filter("sppmi > 0").select("center", "context", "sppmi"), "sppmi")


def cell_factors(spark, folder):
    return factors.truncated_svd(kept_cells(spark, folder), FACTORS)


def svd_vectors(spark, folder):
    """Singular vectors of all cells, zeros among them: each one's words, whether its value is no
    larger than the one before, and whether one more product of the matrix confirms it."""
    cells = kept_cells(spark, folder)
    found = factors.truncated_svd(cells, FACTORS)
    width = len(found.values)
    image = factors.product(cells.withColumnRenamed("sppmi", "value"), found.vectors, width)
    both = found.vectors.join(image, "id").select(F.posexplode(F.arrays_zip("vector", "image")).alias("at", "x"))
    seen = both.groupBy("at").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.col("x.vector") * F.col("x.image")).alias("ray"),
        F.sum(F.col("x.image") * F.col("x.image")).alias("square"))
    value = F.element_at(F.array(*[F.lit(float(v)) for v in found.values] or [F.lit(0.0)]), F.col("at") + 1)
    falls = [bool(a >= b) for a, b in zip([float("inf"), *found.values], found.values)]
    near = F.lit(1e-6 * float(max(found.values, default=0.0)))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("ray") * F.col("ray")))
    return seen.select((F.col("at") + 1).alias("component"), "n_words",
                       F.element_at(F.array(*[F.lit(x) for x in falls] or [F.lit(True)]), F.col("at") + 1).alias("falls"),
                       ((rest <= near) & (F.abs(F.abs(F.col("ray")) - value) <= near)).alias("holds"))


def id_vectors(spark, folder, vocab):
    """Exact stand-in vectors: each vocabulary id takes an embedding in turn."""
    given = table(spark, folder, "embeddings")
    n_given = given.count()
    slots = vocab.select("id", (F.col("id") % n_given).cast("long").alias("vec_id"))
    given = given.select("vec_id", F.col("embedding").alias("vector"))
    return written(slots.join(given, "vec_id").select("id", "vector"), "id_vectors")


def doc_vectors(spark, folder):
    vocab = saved_vocabulary(spark, folder)
    docs = cluster(documents(spark, folder), "doc_id")
    ids = vocabulary.index_sentences(corpus.sentences(docs, remove_stopwords=True), vocab)
    pooled = vectors.document_vectors(
        table(spark, folder, "documents"), ids, id_vectors(spark, folder, vocab))
    return pooled.select("doc_id", F.posexplode_outer("vector").alias("dim", "value")).select(
        "doc_id", "dim", F.round("value", 6).alias("value"))


def unit_vectors(spark, folder):
    given = table(spark, folder, "embeddings").select("vec_id", "embedding")
    unit = vectors.unit_vectors(given, "embedding")
    return unit.select("vec_id", F.posexplode_outer("embedding").alias("dim", "value")).select(
        "vec_id", "dim", F.round("value", 6).alias("value"))


def bigram_perplexity(spark, folder):
    vocab = saved_vocabulary(spark, folder)
    docs = cluster(documents(spark, folder), "doc_id")
    ids = vocabulary.index_sentences(corpus.sentences(docs, remove_stopwords=True), vocab)
    counted = bigram.steps(ids, assign_split(F.col("doc_id")))
    scored = bigram.perplexity(counted, vocab.count(), SMOOTHING)
    return scored.select("n_train", "n_targets", F.round("cross_entropy", 6).alias("cross_entropy"),
                         F.round("perplexity", 3).alias("perplexity"))


def masked_cost(spark, folder):
    """Cost of the framed next sentences: the mean of -log p over the mask."""
    vocab = saved_vocabulary(spark, folder)
    counted = bigram.framed_steps(framed(spark, folder), assign_split(F.col("doc_id")))
    scored = bigram.perplexity(counted, vocab.count(), SMOOTHING)
    return scored.select("n_train", "n_targets", F.round("cross_entropy", 6).alias("cost"))


QUERIES = {f.__name__: f for f in (
    subsampled_tokens, skipgram_pairs, noise_distribution, negative_samples, sgns_vectors, sppmi, sppmi_vectors, svd_vectors, doc_vectors, unit_vectors,
    bigram_perplexity, masked_cost)}
