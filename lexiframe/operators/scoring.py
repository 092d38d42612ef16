"""Score stored experiments: reuse a stored report, or load, fit and store."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators import classify
from lexiframe.operators import experiments as ex
from lexiframe.sources import reports as rp
from lexiframe.sources import vectors as vs

FITS = 4


def score_experiment(vectors: DataFrame, labels: DataFrame, name: str, n_classes: int,
                     stages: int = classify.ESTIMATORS, **options) -> DataFrame:
    """One experiment's best report as `name` and four scores."""
    own = vectors.filter(F.col("experiment") == name).select("doc_id", "split", "vector")
    rows = ex.with_labels(own, labels)
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    best = classify.classify(train, test, n_classes, stages, **options)
    return best.select(F.lit(name).alias("name"), *rp.REPORT_METRICS)


def score_pending(spark: SparkSession, vectors_path: str, labels: DataFrame, reports_path: str,
                  n_classes: int, stages: int = classify.ESTIMATORS, fits: int = FITS, **options) -> DataFrame:
    """Reports of all experiments; only those without one are fitted.

    An experiment is fitted once it has labelled vectors of both splits; until then it
    stays pending. Only names come to the driver: each needs a fit of its own. `fits`
    of them run side by side, and every report is stored as it comes, so a broken run
    resumes where it stopped.
    """
    vectors = vs.read_vectors(spark, vectors_path)

    def score(row) -> None:
        report = score_experiment(vectors, labels, row["name"], n_classes, stages, **options)
        with storing:  # appends to one folder take turns
            rp.write_reports(report, reports_path)

    storing = Lock()
    waiting = ex.pending(ready(vectors, labels), rp.read_reports(spark, reports_path)).orderBy("name").collect()
    with ThreadPoolExecutor(fits) as pool:
        list(pool.map(score, waiting))
    return rp.read_reports(spark, reports_path)


def ready(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """`name, n_train, n_test` of the experiments with labelled vectors of both splits."""
    usable = vectors.filter(F.col("vector").isNotNull()).join(labels.select("doc_id").distinct(), "doc_id")
    return ex.train_and_test(usable.select(F.col("experiment").alias("name"), "split"))
