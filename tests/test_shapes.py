"""Widths, shapes and classes come from the data; staged scoring runs from any folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiframe.functions import names
from lexiframe.functions import sequences as sq
from lexiframe.operators import vectors
from lexiframe.plans import arrays

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def wide(spark, folder):
    """Seventy cells and a label of 12."""
    rows = [(k, [float((k * 7 + i) % 11) for i in range(70)], 12 if k == 3 else k % 3) for k in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def test_grid_of_seventy_cells(spark, wide):
    folder, rows = wide
    got = {(r.vec_id, r.view, r.row, r.col): r.x for r in arrays.vector_grid(spark, folder).collect()}
    assert len(got) == 2 * 8 * 70
    assert all(got[k, "rows", i // 10, i % 10] == got[k, "cols", i % 10, i // 10] == v
               for k, values, _ in rows for i, v in enumerate(values))


def test_every_label_has_its_class(spark, wide):
    folder, rows = wide
    hot = {(r["vec_id"], r["class"]): r["hot"] for r in arrays.one_hot_labels(spark, folder).collect()}
    assert len(hot) == 8 * 13 and all(hot[k, label] == 1 for k, _, label in rows) and sum(hot.values()) == 8


def test_scores_by_plan_and_by_table_agree(spark, wide):
    folder, _ = wide
    few, many = ({(r["vec_id"], r["class"]): r["score"] for r in arrays.vector_scores(spark, folder, n).collect()}
                 for n in (256, 1))
    assert few.keys() == many.keys() and {c for _, c in few} == {0, 1, 2, 12}
    assert all(abs(few[k] - many[k]) < 1e-4 for k in few)


def test_widths_must_agree(spark):
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>")
    with pytest.raises(ValueError):
        vectors.vector_width(uneven)
    with pytest.raises(Exception, match="not 2 x 2"):
        uneven.select(sq.to_grid(F.col("vector"), 2, 2)).collect()


def test_no_sentence_is_cut_and_no_word_dropped(spark):
    long = [f"w{k}" for k in range(1500)]
    sents = spark.createDataFrame([(long,), (["a", "b"],)], "words array<string>")
    model = vectors.fit_word_vectors(sents, 4, iterations=1)
    assert model.getVectors().count() == 1502 and model.getMaxSentenceLength() == 1500


def test_factor_vectors(spark):
    cells = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)], "center int, context int, sppmi double")
    got = {r["id"]: len(r["vector"]) for r in vectors.factor_vectors(cells, 3, 2).collect()}
    assert got == {1: 3, 2: 3}


def test_numbers_too_big_are_rejects(spark):
    good = "next_cell_gru_dir_bi_bat_64_maxlen_12_unit_32_layer_2_epoch_5_1700000000"
    rows = spark.createDataFrame([(good,), (good.replace("bat_64", "bat_99999999999"),), (None,)], "name string")
    texts = names.field_texts(F.col("name"))
    assert [r[0] for r in rows.select(names.is_experiment(texts)).collect()] == [True, False, False]


SCRIPT = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import sys
sys.path.insert(0, sys.argv[1])
from lexiframe.operators import classify
rows = spark.createDataFrame([(k, [float(k % 5), float(k)], k % 2) for k in range(40)],
                             "doc_id long, vector array<double>, label int")
assert classify.stage_reports(rows, rows, 2, 3).count() == 3
"""


def test_staged_scoring_runs_from_another_folder(folder):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=folder, env=clean,
                          capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
