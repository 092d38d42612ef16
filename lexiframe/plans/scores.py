"""Registered queries over labels, predictions and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.config import REPORT_METRICS
from lexiframe.functions.sequences import argmax
from lexiframe.operators import metrics
from lexiframe.plans.arrays import CLASSES
from lexiframe.sources.tables import table

STAGES = 20
STAGE_CHARS = 150


def rounded(rows, names):
    return rows.withColumns({n: F.round(n, 6) for n in names})


def class_predictions(spark, folder):
    """A ten-class prediction from each embedding."""
    return table(spark, folder, "embeddings").select(
        "label", (argmax(F.col("embedding")) % CLASSES).alias("prediction"))


def stage_predictions(spark, folder):
    """Quality of each labelled document as told by a length threshold per stage."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    stages = F.explode(F.sequence(F.lit(1), F.lit(STAGES))).alias("stage")
    rows = docs.join(labels, "doc_id").select("lang", "label", "n_chars", stages)
    longer = F.col("n_chars") > F.col("stage") * STAGE_CHARS
    return rows.select("lang", "stage", "label", longer.cast("int").alias("prediction"))


def stage_reports(spark, folder):
    by = ["lang", "stage"]
    return metrics.weighted_report(metrics.confusion(stage_predictions(spark, folder), by), by)


def confusion(spark, folder):
    return metrics.confusion(class_predictions(spark, folder))


def class_scores(spark, folder):
    scores = metrics.class_scores(metrics.confusion(class_predictions(spark, folder)))
    return rounded(scores, REPORT_METRICS[1:])


def weighted_metrics(spark, folder):
    return rounded(metrics.weighted_report(confusion(spark, folder)), REPORT_METRICS)


def stage_metrics(spark, folder):
    return rounded(stage_reports(spark, folder), REPORT_METRICS)


def stage_best(spark, folder):
    return rounded(metrics.best_stage(stage_reports(spark, folder), ["lang"]), REPORT_METRICS)


def running_best(spark, folder):
    best = metrics.running_best(stage_metrics(spark, folder), ["lang"])
    return best.select("lang", "stage", "f_measure", "best_f")


def votes(spark, folder):
    """Votes for each class at each stage, one embedding cell apiece."""
    cells = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.posexplode("embedding").alias("cell", "x"))
    stage = F.floor(F.col("cell") / CLASSES).cast("int") + 1
    weight = F.when(stage == 1, F.lit(1.0)).otherwise(F.lit(0.1))
    return cells.select("row_id", "label", (F.col("cell") % CLASSES).alias("class"),
                         stage.alias("stage"), weight.alias("weight"),
                         F.col("x").cast("double").alias("vote"))


def staged_votes(spark, folder):
    return metrics.staged_votes(votes(spark, folder))


QUERIES = {f.__name__: f for f in (
    confusion, class_scores, weighted_metrics, stage_metrics, stage_best, running_best,
    staged_votes)}
