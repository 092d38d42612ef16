"""Registered queries over experiments; each order stands for one exported run."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.config import EXPERIMENT_FIELDS, REPORT_METRICS
from lexiframe.functions import names
from lexiframe.functions.hashing import assign_split
from lexiframe.functions.sequences import total
from lexiframe.operators import experiments as ex
from lexiframe.operators.scoring import ready
from lexiframe.plans.layout import new_path, spread
from lexiframe.sources import reports as rp
from lexiframe.sources import vectors as vs
from lexiframe.sources.tables import table

TOP = 10
TOP_PER_GROUP = 3


def runs(spark, folder):
    """Name and report of a run per order; low priority ones have another name."""
    orders = spread(table(spark, folder, "orders"), "o_orderkey")
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    run_time = (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
                .cast("long") * 86400)
    model = names.model_name(
        F.when(F.col("o_orderstatus") == "O", "self").otherwise("next"),
        F.when(order % 2 == 0, "gru").otherwise("lstm"),
        F.when(cust % 2 == 0, "uni").otherwise("bi"),
        64 * (1 + order % 4), 10 * (2 + cust % 5), 128 * (1 + cust % 3), 1 + order % 6)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", model.alias("model"),
        (5 * (1 + order % 20)).alias("epoch"), run_time.alias("run_time"),
        (cents % 10007 / F.lit(10007.0)).alias("accuracy"),
        (cents % 9973 / F.lit(9973.0)).alias("precision"),
        (cents % 10007 / F.lit(10007.0)).alias("recall"),
        (cents % 9949 / F.lit(9949.0)).alias("f_measure"))
    named = names.experiment_name(F.col("model"), F.col("epoch"), F.col("run_time"))
    other = F.format_string("notes_%d.txt", order)
    return rows.withColumn(
        "name", F.when(F.col("o_orderpriority") == "5-LOW", other).otherwise(named))


def experiment_names(spark, folder):
    return runs(spark, folder).select("o_orderkey", "name")


def experiment_parse(spark, folder):
    return ex.parsed(experiment_names(spark, folder)).select(
        "o_orderkey", *[f for f, _ in EXPERIMENT_FIELDS])


def experiment_rejects(spark, folder):
    return ex.unparsed(experiment_names(spark, folder))


def experiment_files(spark, folder):
    """Names of training exports among files of two kinds."""
    suffix = F.when(F.col("o_orderstatus") == "F", "_result.json").otherwise("_train.msgpack")
    files = runs(spark, folder).select("o_orderkey", F.concat("name", suffix).alias("file"))
    exports = files.filter(F.col("file").endswith("_train.msgpack"))
    return exports.select("o_orderkey", names.strip_suffix(F.col("file")).alias("name"))


def experiment_latest(spark, folder):
    """Last report of each model and epoch."""
    rows = runs(spark, folder).select("model", "epoch", "run_time", "o_orderkey", *REPORT_METRICS)
    return ex.latest(rows, ["model", "epoch"], ["run_time", "o_orderkey"])


def experiment_pending(spark, folder):
    """Names exported and not scored, and the stored scores of the others."""
    rows = runs(spark, folder)
    exported = rows.select("name").distinct()
    scored = rows.filter(F.col("o_orderstatus") == "F").groupBy("name").agg(
        F.max("f_measure").alias("f_measure"))
    waiting = ex.pending(exported, scored)
    return waiting.withColumn("f_measure", F.lit(None).cast("double")).unionByName(scored)


def experiment_splits(spark, folder):
    """Models and epochs that have both a training and a test export."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rows = runs(spark, folder).select(
        F.format_string("%s_epoch_%d", "model", "epoch").alias("name"),
        F.when(urgent, "train").otherwise("test").alias("split"))
    return ex.train_and_test(rows)


def labelled_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.round(total(F.col("embedding")), 6).alias("total"))
    return ex.with_labels(vectors, table(spark, folder, "labels"))


def experiment_ready(spark, folder):
    """Models and epochs with labelled exports of both splits; finished orders have labels."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rows = runs(spark, folder).select(
        F.format_string("%s_epoch_%d", "model", "epoch").alias("experiment"),
        F.when(urgent, "train").otherwise("test").alias("split"),
        F.col("o_orderkey").alias("doc_id"), F.array("o_totalprice").alias("vector"), "o_orderstatus")
    return ready(rows, rows.filter(F.col("o_orderstatus") == "F"))


def leaderboard(spark, folder):
    rows = ex.parsed(runs(spark, folder).select("o_orderkey", "name", *REPORT_METRICS))
    return ex.top(rows, TOP, ties=["name", "o_orderkey"]).select(
        "o_orderkey", "name", *REPORT_METRICS)


def leaderboard_by_cell(spark, folder):
    rows = ex.parsed(runs(spark, folder).select("o_orderkey", "name", "f_measure"))
    return ex.top(rows, TOP_PER_GROUP, ties=["name", "o_orderkey"],
                  by=["inf_mode", "cell_type", "rnn_direction"]).select(
        "inf_mode", "cell_type", "rnn_direction", "place", "name", "f_measure")


def report_table(spark, folder):
    rows = runs(spark, folder).select("o_orderkey", "name", *REPORT_METRICS)
    return ex.report_table(rows, ties=["o_orderkey"])


def resume_epoch(spark, folder):
    rows = runs(spark, folder).select("model", "epoch", "o_orderstatus")
    return ex.resume_epochs(rows, rows.filter(F.col("o_orderstatus") == "F"))


def epoch_cost(spark, folder):
    costs = runs(spark, folder).select("epoch", F.col("o_totalprice").alias("cost"))
    return ex.epoch_cost(costs).withColumn("mean_cost", F.round("mean_cost", 4))


def stored_reports(spark, folder):
    """Reports written as JSON rows and read back."""
    path = new_path(spark, "reports")
    rp.write_reports(runs(spark, folder), path)
    return rp.read_reports(spark, path)


def stored_vectors(spark, folder):
    """Vectors written per experiment and split, listed and read back."""
    path = new_path(spark, "vectors")
    given = table(spark, folder, "embeddings").select(
        F.concat(F.lit("label_"), "label").alias("experiment"),
        assign_split(F.col("vec_id")).alias("split"),
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    vs.write_vectors(given, path)
    return vs.read_vectors(spark, path).groupBy("experiment", "split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("vector")).alias("n_values"))


QUERIES = {f.__name__: f for f in (
    experiment_names, experiment_parse, experiment_rejects, experiment_files, experiment_latest,
    experiment_pending, experiment_splits, experiment_ready, labelled_vectors, leaderboard, leaderboard_by_cell,
    report_table, resume_epoch, epoch_cost, stored_reports, stored_vectors)}
