"""Shapes of the main plans: shuffles, joins, pruned columns."""

import re

import pytest

import __spark_entry__ as spark_entry


def plan(spark, small, name):
    return spark_entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text.replace("BroadcastExchange", ""))


@pytest.mark.parametrize("name", ["self_pairs", "next_pairs", "pair_frames", "sentence_matrix"])
def test_frames_move_the_text_once_and_nothing_after(spark, small, name):
    text = plan(spark, small, name)
    assert exchanges(text) == ["hashpartitioning"]
    assert "hashpartitioning(doc_id" in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("name, columns", [
    ("word_counts", {"doc_id", "text"}), ("stage_metrics", {"doc_id", "lang", "n_chars"})])
def test_scans_read_only_what_they_use(spark, small, name, columns):
    text = plan(spark, small, name)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    read = {field.split(":")[0] for field in schemas[0].split(",")}
    assert read == columns


def test_skipgram_shuffles_counted_pairs_only(spark, small):
    assert exchanges(plan(spark, small, "skipgram_pairs")) == ["hashpartitioning"] * 2


def test_no_cross_joins(spark, small):
    for name in ("sppmi", "vector_scores", "bigram_perplexity", "report_table", "leaderboard"):
        text = plan(spark, small, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_topk_is_not_a_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(spark, small, "leaderboard")


def test_groups_are_cut_to_their_best_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(spark, small, "leaderboard_by_cell")


def test_regular_expressions_run_once(spark, small):
    text = plan(spark, small, "sentence_tokens")
    assert text.count("[^a-zA-Z]") == 1 and text.count("[.!?]") == 1


def test_large_vocabulary_moves_no_tokens(spark, small):
    """Above the limit the rarer words of a document go out, its tokens stay."""
    from pyspark.sql import functions as F

    from lexiframe.operators import corpus, vocabulary
    from lexiframe.plans.layout import cluster
    from lexiframe.plans.texts import documents, saved_vocabulary

    vocab = saved_vocabulary(spark, small)
    sents = corpus.sentences(cluster(documents(spark, small), "doc_id"), remove_stopwords=True)
    small_limit = vocabulary.index_sentences(sents, vocab, limit=4096)
    text = small_limit._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in text and not re.search(r"hashpartitioning\(doc_id#\d+L?, sent_id", text)
    both = [sorted(map(tuple, f.select("doc_id", "sent_id", F.col("ids").cast("string")).collect()))
            for f in (small_limit, vocabulary.index_sentences(sents, vocab))]
    assert both[0] == both[1]


@pytest.mark.parametrize("name", ["leaderboard", "leaderboard_by_cell", "experiment_parse", "experiment_rejects"])
def test_names_are_matched_and_formatted_once(spark, small, name):
    text = plan(spark, small, name).split("== Initial Plan ==")[0]
    assert text.count("regexp_replace") == 1 and text.lower().count("rlike") == 0
    assert len(re.findall(r"format_string\(%s_epoch", text)) == 1


def test_report_table_is_numbered_without_a_full_sort(spark, small):
    text = plan(spark, small, "report_table")
    assert "regexp_replace" not in text and not exchanges(text)  # read from the numbered rows
    assert "Window" not in text


def test_noise_is_looked_up_where_the_pairs_lie(spark, small):
    """Ten draws a pair are no rows: nothing moves but the counted pairs."""
    text = plan(spark, small, "negative_samples")
    assert exchanges(text) == ["hashpartitioning"] * 2
    assert "collect_list" not in text


def test_cells_meet_their_sums_where_they_lie(spark, small):
    assert exchanges(plan(spark, small, "sppmi")) == []


def test_labelled_documents_move_once_where_splits_are_many(spark, small, monkeypatch):
    from lexiframe.plans import learning

    seen = []
    monkeypatch.setattr(learning, "written", lambda rows, step: seen.append(rows) or rows)
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        learning.labelled_doc_vectors(spark, small)
        text = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert exchanges(text) == ["hashpartitioning"] and "hashpartitioning(doc_id" in text
