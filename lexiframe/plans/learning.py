"""Registered queries that fit models or run streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.config import REPORT_METRICS
from lexiframe.functions.hashing import assign_split
from lexiframe.functions.sequences import squared_norm
from lexiframe.operators import boosting, classify, corpus, metrics, skipgram, vectors, vocabulary
from lexiframe.operators import experiments as ex
from lexiframe.operators.scoring import score_pending
from lexiframe.plans.layout import cluster, new_path, shared_folder, written
from lexiframe.plans.runs import runs
from lexiframe.plans.texts import SETTINGS, documents, saved_vocabulary
from lexiframe.plans.vectors import VECTOR_SIZE, id_vectors, trained_words
from lexiframe.sources import partial
from lexiframe.sources.artefacts import code_identity, input_identity, reuse_or_write
from lexiframe.sources.reports import read_reports, write_reports
from lexiframe.sources.tables import table
from lexiframe.sources.vectors import read_vectors, write_vectors
from lexiframe.streaming.documents import read_documents, run_index
from lexiframe.streaming.experiments import read_batches, run_fits, run_scoring

WORD_ITERATIONS = 25
STAGES = 300


def word_vectors(spark, folder):
    """Unit skip-gram vectors of down-sampled sentences: each word's width and norm."""
    vocab = saved_vocabulary(spark, folder)
    docs = cluster(documents(spark, folder), "doc_id")
    toks = skipgram.subsample(corpus.tokens(corpus.sentences(docs)), vocab, SETTINGS.sample)
    sents = written(skipgram.regroup(toks), "kept_sentences")
    model = vectors.fit_word_vectors(sents, VECTOR_SIZE, SETTINGS, WORD_ITERATIONS,
                                     partitions=spark.sparkContext.defaultParallelism)
    norm = F.sqrt(squared_norm(F.col("vector")))
    return vectors.unit_word_vectors(model).select(
        "word", F.size("vector").alias("width"), F.round(norm, 6).alias("norm"))


def labelled_doc_vectors(spark, folder):
    """Pooled vectors of the labelled documents, written for the many passes of a fit."""
    vocab = saved_vocabulary(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    # sentences are regrouped and pooled where their document lies; the filter goes below the move
    chosen = cluster(docs, "doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    ids = vocabulary.index_sentences(corpus.sentences(chosen, remove_stopwords=True), vocab)
    pooled = vectors.pooled_vectors(vectors.indexed_weights(ids), id_vectors(spark, folder, vocab))
    rows = ex.with_labels(pooled, labels).withColumn("split", assign_split(F.col("doc_id"), "0123"))
    return written(rows, "labelled_vectors")


def _sides(rows):
    return (rows.filter(F.col("split") == s) for s in ("train", "test"))


def _saved_stages(spark, folder):
    """Reports of all stages of one fit, kept for the queries that read them."""
    def make():
        train, test = _sides(labelled_doc_vectors(spark, folder))
        return classify.stage_reports(train, test, 2, STAGES)

    tables = [f"{folder}/{t}.parquet" for t in ("documents", "labels", "embeddings")]
    return reuse_or_write(spark, f"{shared_folder(spark)}/lexiframe/kept", "stage_reports", SETTINGS,
                          (input_identity(spark, tables), code_identity(classify, metrics, vectors), STAGES), make)


def boosted_stages(spark, folder):
    """Every stage's report: its rows, and whether accuracy is the weighted recall, as it must be."""
    same = F.abs(F.col("accuracy") - F.col("recall")) < 1e-9
    return _saved_stages(spark, folder).select("stage", "n_rows", same.alias("recall_is_accuracy"))


def boosted_trees(spark, folder):
    """The best stage against all: none has a higher F, none earlier has the same."""
    reports = _saved_stages(spark, folder)
    best = metrics.best_stage(reports).first()
    better = (F.col("f_measure") > best["f_measure"]) | (
        (F.col("f_measure") == best["f_measure"]) & (F.col("stage") < best["stage"]))
    return reports.agg(F.count(F.lit(1)).alias("n_stages"), F.count_if(better).alias("n_better"),
                       F.max("n_rows").alias("n_rows"))


def _embedded(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), "label", assign_split(F.col("vec_id"), "0123").alias("split"))


def _classes(rows):
    return (rows.agg(F.max("label")).first()[0] or 0) + 1


def joint_first_stage(spark, folder):
    """The first stage of a joint fit of all classes of the embeddings: splits, then leaf values."""
    rows = _embedded(spark, folder)
    model = boosting.fit_boosted(rows, _classes(rows), 1)
    stage, out = model.stages[0], []
    for c, (features, bins, values) in enumerate(zip(stage.features, stage.bins, stage.values)):
        for at in range(len(features)):
            level = (at + 1).bit_length() - 1
            if features[at] >= 0:
                out.append((c, level, at + 1 - (1 << level), int(features[at]), int(bins[at]), None))
        out += [(c, model.depth, node, None, None, float(v)) for node, v in enumerate(values)]
    found = spark.createDataFrame(out, "class int, level int, node int, feature int, bin int, value double")
    return found.withColumn("value", F.round("value", 6))


def joint_stages(spark, folder):
    """Reports of all stages of a joint fit, held-out rows; the last one is the whole model's."""
    def make():
        train, test = _sides(_embedded(spark, folder))
        model = boosting.fit_boosted(train, _classes(_embedded(spark, folder)), STAGES)
        whole = metrics.weighted_report(metrics.confusion(boosting.predictions(test, model, "vec_id")))
        staged = metrics.weighted_report(boosting.staged_confusion(test, model), ["stage"])
        return staged.withColumn("whole", F.lit(False)).unionByName(
            whole.withColumns({"stage": F.lit(STAGES), "whole": F.lit(True)}))

    return reuse_or_write(spark, f"{shared_folder(spark)}/lexiframe/kept", "joint_stages", SETTINGS,
                          (input_identity(spark, [f"{folder}/embeddings.parquet"]),
                           code_identity(boosting, metrics), STAGES), make)


def joint_boosted(spark, folder):
    """Every stage's held-out rows, and whether the last stage's scores are those of the model itself."""
    reports = joint_stages(spark, folder)
    whole = reports.filter("whole").select("stage", *[F.col(m).alias(f"own_{m}") for m in REPORT_METRICS])
    same = reduce(Column.__and__, [F.abs(F.col(m) - F.col(f"own_{m}")) < 1e-9 for m in REPORT_METRICS])
    staged = reports.filter("NOT whole").join(F.broadcast(whole), "stage", "left")
    return staged.select("stage", "n_rows", same.alias("last_is_model"))


def learned_doc_vectors(spark, folder):
    """Documents pooled from word vectors that were trained on them: widths, null where no word is known."""
    vocab = saved_vocabulary(spark, folder)
    words = trained_words(spark, folder).select("id", "vector")
    ids = vocabulary.index_sentences(
        corpus.sentences(cluster(documents(spark, folder), "doc_id"), remove_stopwords=True), vocab)
    pooled = vectors.document_vectors(table(spark, folder, "documents"), ids, words)
    return pooled.select("doc_id", F.size("vector").alias("width"), (squared_norm(F.col("vector")) > 0).alias("moved"))


def learned_boosting(spark, folder):
    """The whole chain: words, vectors trained on them, pooled documents, joint boosting on their
    quality: each stage's held-out rows."""
    vocab = saved_vocabulary(spark, folder)
    words = trained_words(spark, folder).select("id", "vector")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = cluster(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").join(
        labels.select("doc_id"), "doc_id", "left_semi")
    ids = vocabulary.index_sentences(corpus.sentences(docs, remove_stopwords=True), vocab)
    pooled = vectors.pooled_vectors(vectors.indexed_weights(ids), words)
    rows = written(ex.with_labels(pooled, labels).withColumn("split", assign_split(F.col("doc_id"), "0123")), "learned")
    train, test = _sides(rows)
    reports = boosting.stage_reports(train, test, 2, STAGES)
    return reports.select("stage", "n_rows", (F.abs(F.col("accuracy") - F.col("recall")) < 1e-9).alias("recall_is_accuracy"))


def scored_experiments(spark, folder):
    """Two stored experiments, raw and unit vectors; the one with a report is not fitted.

    A report that was there keeps its scores, even impossible ones.
    """
    stored, done = new_path(spark, "vectors"), new_path(spark, "reports")
    rows = labelled_doc_vectors(spark, folder)
    unit = vectors.unit_vectors(rows).withColumn("experiment", F.lit("unit"))
    write_vectors(rows.withColumn("experiment", F.lit("raw")).unionByName(unit), stored)
    given = spark.range(1).select(F.lit("raw").alias("name"), *[F.lit(2.0).alias(m) for m in REPORT_METRICS])
    write_reports(given, done)
    reports = score_pending(spark, stored, rows.select("doc_id", "label"), done, 2, STAGES)
    return reports.select("name", (F.col("f_measure") == 2).alias("reused"),
                          F.col("f_measure").between(0, 1).alias("fitted"))


def softmax_regression(spark, folder):
    """A softmax fit on the embeddings: its held-out rows, and whether its cost fell."""
    rows = table(spark, folder, "embeddings").select(
        F.col("embedding").alias("vector"), "label", assign_split(F.col("vec_id"), "0123").alias("split"))
    train, test = _sides(rows)
    model = classify.fit_softmax(train)
    cost = model.summary.objectiveHistory
    scored = classify.softmax_predictions(model, test)
    reports = metrics.weighted_report(metrics.confusion(scored))
    return reports.select("n_rows", F.lit(cost[-1] < cost[0]).alias("cost_falls"),
                          (F.abs(F.col("accuracy") - F.col("recall")) < 1e-9).alias("recall_is_accuracy"))


def stream_tokens(spark, folder):
    """Documents indexed as a stream; equals the batch result."""
    output, checkpoint = new_path(spark, "stream_tokens"), new_path(spark, "stream_state")
    # a file or a folder of files; streams take a file only by a pattern
    arriving = read_documents(spark, f"{folder}/{{documents.parquet}}", "*")
    run_index(arriving, saved_vocabulary(spark, folder), output, checkpoint,
              spread_to=2 * spark.sparkContext.defaultParallelism)
    return spark.read.parquet(output)


def incremental_counts(spark, folder):
    """Words counted file by file: four files first, then a fifth, of which alone is read again."""
    arriving, kept = new_path(spark, "arriving"), new_path(spark, "partial_counts")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    for wave in ("doc_id % 5 < 4", "doc_id % 5 = 4"):
        docs.filter(wave).write.mode("append").parquet(arriving)
        counted = partial.counted_files(spark, [arriving], kept, corpus.file_words)
    return counted.totals.select("word", "cnt", F.lit(counted.read_rows).cast("long").alias("read_rows"))


def stream_fits(spark, folder):
    """Vectors of two experiments that arrive in two waves, the second one's test split last: each is
    fitted once, as soon as both its splits are there."""
    stored, done, state = (new_path(spark, s) for s in ("vectors", "reports", "stream_state"))
    rows = _embedded(spark, folder).withColumnRenamed("vec_id", "doc_id")
    late = F.col("experiment").eqNullSafe("unit") & (F.col("split") == "test")
    both = rows.withColumn("experiment", F.lit("raw")).unionByName(
        vectors.unit_vectors(rows).withColumn("experiment", F.lit("unit")))
    labels, classes = rows.select("doc_id", "label"), _classes(rows)
    for wave in (~late, late):
        write_vectors(both.filter(wave), stored)
        run_fits(spark, stored, labels, done, state, lambda train, test: fit_score(train, test, classes))
    return read_batches(spark, done).select("name", (F.col("f_measure") > 0).alias("fitted"))


def fit_score(train, test, n_classes):
    """Held-out scores of a softmax fit."""
    model = classify.fit_softmax(train)
    return metrics.weighted_report(metrics.confusion(classify.softmax_predictions(model, test)))


def stream_pending(spark, folder):
    """Two waves of exports; the second repeats the first and adds more."""
    exports, reports, checkpoint = (new_path(spark, s) for s in ("exports", "reports", "stream_state"))
    rows = runs(spark, folder).select("o_orderkey", "o_orderstatus", "run_time", "name", *REPORT_METRICS)

    def score(batch):
        return ex.latest(batch, ["name"], ["run_time", "o_orderkey"])

    for wave in (rows.filter(F.col("o_orderstatus") == "F"), rows):
        wave.write.mode("append").json(exports)
        run_scoring(spark, exports, rows.schema, reports, checkpoint, score)
    return read_reports(spark, reports)


QUERIES = {f.__name__: f for f in (
    word_vectors, boosted_trees, boosted_stages, joint_first_stage, joint_boosted, learned_doc_vectors,
    learned_boosting, scored_experiments, softmax_regression,
    stream_tokens, stream_pending, stream_fits, incremental_counts)}
