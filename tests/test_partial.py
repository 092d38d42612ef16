"""Counts kept per file: only new and changed files are read."""

from util import documents, random_texts

from lexiframe.operators import corpus
from lexiframe.sources import partial


def test_only_new_files_are_read(spark, folder):
    given, kept = f"{folder}/in", f"{folder}/kept"
    texts = random_texts(30, seed=4)

    def add(part, mode="append", name="a"):
        documents(spark, part).coalesce(1).write.mode(mode).parquet(f"{given}/{name}")

    def run(*held):
        found = partial.counted_files(spark, [given], kept, corpus.file_words)
        want = corpus.word_counts(corpus.sentences(documents(spark, [t for part in held for t in part])))
        assert sorted(map(tuple, found.totals.collect())) == sorted(map(tuple, want.collect()))
        return found.read_files, found.read_rows

    first, second, third = texts[:10], texts[10:17], texts[17:]
    add(first)
    assert run(first) == (1, 10) and run(first) == (0, 0)
    add(second)
    add(third, name="b")
    assert run(*(first, second, third)) == (2, 20)
    add(first[:4], "overwrite", "b")  # changed: read anew, the old counts no longer used
    assert run(first, second, first[:4]) == (1, 4)
    spark.createDataFrame([("gone", "x", 9)], "file string, word string, cnt long").write.parquet(
        f"{kept}/counts/batch=broken")  # counts of a run that broke off
    assert run(first, second, first[:4]) == (0, 0)
