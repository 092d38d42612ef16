import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from lexiframe.config import REPORT_METRICS, Settings
from lexiframe.plans import layout
from lexiframe.sources import artefacts, corpus, reports, vectors

TEXTS = ["plain text", 'tab\there, "quoted" word', "two\nlines\r\nand more", "  outer blanks  ",
         "back\\slash", '"', "a" * 300_000]


def test_corpus_round_trip(spark, folder):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "label int, text string")
    corpus.write_corpus(rows, f"{folder}/train")
    got = corpus.read_corpus(spark, f"{folder}/train", "train")
    assert corpus.bad_rows(got).count() == 0
    good = corpus.good_rows(got)
    assert good.columns == ["split", "label", "text"]
    assert {r.label: r.text for r in good.collect()} == dict(enumerate(TEXTS))


def test_bad_rows_are_set_apart(spark, folder):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/x.tsv", "w") as f:
        f.write("class\tnews\n1\tfine text\nno number\ttext\n2\t\n3\tlast\n")
    got = corpus.read_corpus(spark, f"{folder}/in/x.tsv", "test")
    assert [r.label for r in corpus.good_rows(got).orderBy("label").collect()] == [1, 3]
    assert corpus.bad_rows(got).count() == 2
    ids = corpus.with_doc_id(corpus.good_rows(got))
    assert ids.select("doc_id").distinct().count() == 2


def quoted_file(path, n, seed):
    """A file with a header whose texts hold tabs, quote marks, and line ends of both kinds."""
    rng = random.Random(seed)
    parts = ["word ", "\n", "\r\n", "\n\n", '"', "\t", "é", '"\n"', "long " * 60, ""]
    with open(path, "w", newline="") as f:
        write = csv.writer(f, delimiter="\t", lineterminator=rng.choice(["\n", "\r\n"]))
        write.writerow(["class", "news"])
        for i in range(n):
            write.writerow([i, "".join(rng.choices(parts, k=rng.randint(0, 40))) + "."])
            if rng.random() < 0.1:
                f.write("\n")


@pytest.fixture
def tiny_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_ends_are_read_by_many_tasks(spark, folder, tiny_splits, seed):
    for name, n in (("a.tsv", 120), ("b.tsv", 7), ("c.tsv", 0)):
        quoted_file(f"{folder}/{name}", n, f"{seed} {name}")
    open(f"{folder}/empty.tsv", "w").close()
    columns = ["split", "label", "text", corpus.CORRUPT]
    got = corpus.read_corpus(spark, folder, "x").select(columns).collect()
    want = corpus.read_corpus(spark, folder, "x", whole_files=True).select(columns).collect()
    assert len(want) == 127 and all(r[3] is None for r in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    one = spark.read.text(f"{folder}/a.tsv").rdd.getNumPartitions()
    assert one > 10


def test_a_record_longer_than_many_splits(spark, folder, tiny_splits):
    texts = ["first", "\n".join(f'line {i} "q"' for i in range(2_000)), "between", "\n" * 5_000 + ".", "last"]
    with open(f"{folder}/a.tsv", "w", newline="") as f:
        csv.writer(f, delimiter="\t", lineterminator="\n").writerows([["class", "news"], *enumerate(texts)])
    got = corpus.good_rows(corpus.read_corpus(spark, folder, "x"))
    assert {r.label: r.text for r in got.collect()} == dict(enumerate(texts))


def test_text_of_quoted_files_moves_once(spark, folder):
    quoted_file(f"{folder}/a.tsv", 50, 1)
    plan = corpus.read_corpus(spark, folder, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_quote_marks_within_plain_fields_are_set_apart(spark, folder):
    with open(f"{folder}/a.tsv", "w") as f:
        f.write('class\tnews\n1\tfine\n2\ta "named" thing\n3\t"quoted ""well"""\n4\t"a"\n')
    got = corpus.read_corpus(spark, f"{folder}/a.tsv", "x")
    assert sorted(r.label for r in corpus.good_rows(got).collect()) == [1, 3, 4]
    assert [r[corpus.CORRUPT] for r in corpus.bad_rows(got).collect()] == ['2\ta "named" thing']
    whole = corpus.read_corpus(spark, f"{folder}/a.tsv", "x", whole_files=True)
    assert corpus.good_rows(whole).count() == 4


def test_lines(spark, folder):
    rows = spark.createDataFrame([("train", "a b c"), ("train", "d <unk>"), ("test", "e")],
                                 "split string, line string")
    corpus.write_lines(rows, f"{folder}/lines")
    got = corpus.read_lines(spark, {s: f"{folder}/lines/split={s}" for s in ("train", "test")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    forms = got.filter("line = 'd <unk>'").select(corpus.line_words(F.col("line")),
                                                  corpus.line_chars(F.col("line"))).first()
    assert forms[0] == ["d", "<unk>"] and forms[1] == list("d_<unk>")


def test_reports_round_trip_and_csv(spark, folder):
    rows = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 1 / 3)], reports.REPORT_SCHEMA)
    assert reports.read_reports(spark, f"{folder}/r").count() == 0
    reports.write_reports(rows, f"{folder}/r")
    assert reports.read_reports(spark, f"{folder}/r").collect() == rows.collect()
    reports.write_table(rows.select(F.lit(0).alias("row_index"), "*"), f"{folder}/csv")
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    assert back.columns == ["row_index", "name", *REPORT_METRICS]


def test_one_experiment_is_a_partition_filter(spark, folder):
    rows = spark.createDataFrame(
        [(e, s, i, [float(i), 0.5]) for e in ("a", "b") for s in ("train", "test") for i in range(3)],
        "experiment string, split string, doc_id long, vector array<double>")
    vectors.write_vectors(rows, folder)
    one = vectors.read_vectors(spark, folder, "a")
    assert one.count() == 6
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan


def test_list_files(spark, folder):
    for name in ("x_train.msgpack", "y_train.msgpack", "y_test.msgpack"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("x")
    got = vectors.list_files(spark, folder, "_train.msgpack")
    assert sorted(r["name"] for r in got.collect()) == ["x", "y"]


def test_steps_are_reused_until_settings_or_input_change(spark, folder):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    def run(settings=Settings(), inputs=("v1",)):
        return artefacts.reuse_or_write(spark, f"{folder}/kept", "step", settings, inputs, make).count()

    assert run() == 3 and run() == 3 and len(made) == 1
    run(inputs=("v2",))
    run(settings=Settings(min_count=5))
    assert len(made) == 3


def test_a_step_that_was_cut_off_is_made_again(spark, folder):
    path = f"{folder}/step/{Settings().fingerprint('step')}"
    spark.range(9).write.parquet(path)
    os.unlink(f"{path}/_SUCCESS")
    got = artefacts.reuse_or_write(spark, folder, "step", Settings(), (), lambda: spark.range(2))
    assert got.count() == 2


def test_input_identity_follows_the_files(spark, folder):
    path = f"{folder}/in"
    spark.range(5).coalesce(1).write.parquet(path)
    first = artefacts.input_identity(spark, [path])
    assert first == artefacts.input_identity(spark, [path])
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert first != artefacts.input_identity(spark, [path])


def test_shared_folder_is_the_one_named(spark, monkeypatch):
    own = layout.shared_folder(spark)
    assert own == layout.shared_folder(spark)
    assert layout.new_path(spark, "x") != layout.new_path(spark, "x")
    monkeypatch.setattr(layout, "SETTING", "spark.lexiframe.test.dir")
    spark.conf.set("spark.lexiframe.test.dir", "/shared/place/")
    assert layout.new_path(spark, "x").startswith("/shared/place/lexiframe/x/")


@pytest.mark.parametrize("name", ["spread", "cluster"])
def test_wide_scans_and_narrow_scans(spark, name):
    step = getattr(layout, name)
    narrow = step(spark.range(0, 100, 1, 1), "id")
    assert narrow.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert (step(wide, "id") is wide) == (name == "spread")


def test_lines_move_without_the_name_of_their_file(spark, folder):
    """A line goes to its split's number: a path per line would be longer than most lines."""
    rows = spark.createDataFrame([(1, "one line\nand one more"), (2, 'a "mark"')], "label int, text string")
    corpus.write_corpus(rows, f"{folder}/quoted")
    records = corpus.quoted_records(spark, f"{folder}/quoted")
    plan = records._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(home#" in line for line in moved)
    assert records.count() == 2
