import pytest
from pyspark.sql import functions as F

from lexiframe.functions import names
from lexiframe.operators import experiments as ex

NAME = "next_cell_gru_dir_bi_bat_64_maxlen_12_unit_32_layer_2_epoch_5_1700000000"


def frame(spark, *found):
    return spark.createDataFrame([(n,) for n in found], "name string")


def test_parse(spark):
    got = ex.parsed(frame(spark, NAME, "notes.txt", None, NAME + "_more")).collect()
    want = ("next", "gru", "bi", 64, 12, 32, 2, 5, 1700000000)
    assert [tuple(r)[1:] for r in got] == [want, want]
    rejects = ex.unparsed(frame(spark, NAME, "notes.txt", None)).collect()
    assert [r["name"] for r in rejects] == ["notes.txt", None]


def test_format_is_read_back(spark):
    lit = F.lit
    model = names.model_name(lit("next"), lit("gru"), lit("bi"), lit(64), lit(12), lit(32), lit(2))
    built = frame(spark, "x").select(names.experiment_name(model, lit(5), lit(1700000000)).alias("name"))
    assert built.first()[0] == NAME


def test_field_values_may_hold_underscores(spark):
    got = ex.parsed(frame(spark, "a_b_cell_c_dir_d_bat_1_maxlen_2_unit_3_layer_4_epoch_5_6")).first()
    assert tuple(got)[1:] == ("a_b", "c", "d", 1, 2, 3, 4, 5, 6)


def test_suffix_goes_only_from_the_end(spark):
    got = frame(spark, "a_train.msgpack", "b_train.msgpack.old", "c_train_msgpack").select(
        names.strip_suffix(F.col("name"))).collect()
    assert [r[0] for r in got] == ["a", "b_train.msgpack.old", "c_train_msgpack"]


def test_resume(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    done = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4)], "model string, epoch int")
    got = {r.model: r.next_epoch for r in ex.resume_epochs(models, done).collect()}
    assert got == {"a": 5, "b": 0}


def test_latest_and_pending(spark):
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.2), ("b", 2, 0.3)],
                                 "name string, run_time long, f double")
    got = {r["name"]: r.f for r in ex.latest(rows, ["name"], ["run_time"]).collect()}
    assert got == {"a": 0.2, "b": 0.3}
    assert [r["name"] for r in ex.pending(rows, frame(spark, "a")).collect()] == ["b"]


def test_train_and_test(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("a", "test"), ("b", "train")],
                                 "name string, split string")
    assert [tuple(r) for r in ex.train_and_test(rows).collect()] == [("a", 1, 2)]


def test_export_epochs():
    assert ex.export_epochs(25, 10) == [10, 20]


def test_epoch_cost(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "epoch int, cost double")
    got = {r.epoch: r.mean_cost for r in ex.epoch_cost(rows).collect()}
    assert got == {1: 3.0, 2: 1.0}


def test_run_id(spark):
    assert spark.range(1).select(names.run_id(7)).first()[0] == 7
    assert spark.range(1).select(names.run_id()).first()[0] > 1_600_000_000


def test_report_table_counts_rows_from_zero(spark):
    rows = spark.createDataFrame(
        [(f"next_cell_gru_dir_bi_bat_64_maxlen_12_unit_32_layer_{l}_epoch_{e}_1", 0.1, 0.2, 0.1, 0.3)
         for l in (2, 1) for e in (10, 9)],
        "name string, accuracy double, precision double, recall double, f_measure double")
    got = ex.report_table(rows).orderBy("row_index").collect()
    assert [(r.row_index, r.num_layer, r.epoch) for r in got] == [
        (0, 1, 9), (1, 1, 10), (2, 2, 9), (3, 2, 10)]
    assert got[0].asDict().keys() >= {"inf_mode", "sentence_length", "f_measure"}


@pytest.mark.parametrize("by, want", [((), ["c", "b"]), (("g",), ["a", "b", "c"])])
def test_top(spark, by, want):
    rows = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.5), ("c", 2, 0.9)],
                                 "name string, g int, f_measure double")
    got = [r["name"] for r in ex.top(rows, 2, by=by).collect()]
    assert (sorted(got) if by else got) == want


def test_registered_scoring_uses_all_stages(spark, small, monkeypatch):
    """The registered query fits as many boosting stages as the other boosting queries."""
    from lexiframe.plans import learning
    rows = spark.createDataFrame([(1, [3.0, 4.0], 1, "train"), (2, [1.0, 0.0], 0, "test")],
                                 "doc_id long, vector array<double>, label int, split string")
    asked = []

    def pending(session, stored, labels, done, n_classes, stages):
        asked.append(stages)
        return learning.read_reports(session, done)

    monkeypatch.setattr(learning, "labelled_doc_vectors", lambda *_: rows)
    monkeypatch.setattr(learning, "score_pending", pending)
    assert [tuple(r) for r in learning.scored_experiments(spark, small).collect()] == [("raw", True, False)]
    assert asked == [learning.STAGES] == [300]
