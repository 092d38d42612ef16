"""The three runs end to end on a corpus file made from the given documents."""

import pytest
from pyspark.sql import functions as F

from lexiframe.config import Settings
from lexiframe.functions.hashing import assign_split
from lexiframe.plans import flows
from lexiframe.sources import corpus as source
from lexiframe.sources import reports, vectors

SETTINGS = Settings(max_len=10, batch_size=64, min_count=10)


@pytest.fixture(scope="module")
def docs(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet(f"{small}/documents.parquet").join(
        spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = given.select(F.col("quality").alias("label"), "text",
                        assign_split(F.col("doc_id"), "01234567").alias("split")).cache()
    for split in ("train", "test"):
        source.write_corpus(rows.filter(F.col("split") == split), f"{folder}/{split}")
    paths = {s: f"{folder}/{s}" for s in ("train", "test")}
    got = flows.ingest(spark, paths, f"{folder}/kept", SETTINGS)
    assert got.count() == rows.count()
    return got


def test_runs(spark, docs, folder):
    vocab = flows.build_vocabulary(docs, SETTINGS)
    framed = flows.frame_corpus(docs.filter("split = 'train'"), vocab, SETTINGS)
    batches = flows.epoch_batches(framed, 0, SETTINGS)
    sizes = [r["count"] for r in batches.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sum(sizes) == framed.count() and set(sizes[:-1]) == {64}
    assert batches.filter(F.col("in")[10] == 2).count() < batches.count()

    flows.train_words(docs, vocab, folder, 8, SETTINGS, iterations=1)
    words = vectors.read_word_vectors(spark, folder, 8, SETTINGS)
    for epoch in (10, 20):
        name = flows.experiment_name(spark, SETTINGS, "skipgram", "uni", 8, 1, epoch, 1700000000)
        flows.export_vectors(docs, vocab, words, name, f"{folder}/vectors")
    stored = vectors.read_vectors(spark, f"{folder}/vectors", name)
    assert stored.count() == docs.count()

    table = flows.score_exports(docs, f"{folder}/vectors", f"{folder}/reports", f"{folder}/table",
                                2, run_time=1, stages=2)
    assert [(r.row_index, r.epoch, r.cell_type) for r in table.orderBy("row_index").collect()] == [
        (0, 10, "skipgram"), (1, 20, "skipgram")]
    assert reports.read_reports(spark, f"{folder}/reports").count() == 2
    assert spark.read.option("header", True).csv(f"{folder}/table/run=1").count() == 2

    # an export without its test split waits; a second run adds to the first
    rows = vectors.read_vectors(spark, f"{folder}/vectors", name)
    later = name.replace("_epoch_20_", "_epoch_30_")
    halves = rows.withColumn("experiment", F.lit(later))
    vectors.write_vectors(halves.filter("split = 'train'"), f"{folder}/vectors")
    table = flows.score_exports(docs, f"{folder}/vectors", f"{folder}/reports", f"{folder}/table",
                                2, run_time=2, stages=2)
    assert table.count() == 2
    vectors.write_vectors(halves.filter("split = 'test'"), f"{folder}/vectors")
    table = flows.score_exports(docs, f"{folder}/vectors", f"{folder}/reports", f"{folder}/table",
                                2, run_time=3, stages=2)
    assert table.count() == 3 and table.filter("f_measure IS NULL").isEmpty()
    assert spark.read.option("header", True).csv(f"{folder}/table/run=3").count() == 3
    with pytest.raises(FileExistsError):
        flows.score_exports(docs, f"{folder}/vectors", f"{folder}/reports", f"{folder}/table",
                            2, run_time=3, stages=2)


def test_settings_from_the_environment():
    assert Settings.from_environment({}) == Settings()
    got = Settings.from_environment({"INFERENCE_MODE": "self", "BATCH_SIZE": "8", "OTHER": "x"})
    assert got == Settings(mode="self", batch_size=8)
