"""Registered queries over characters and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.functions import chars as ch
from lexiframe.functions import sequences as sq
from lexiframe.functions import text as tx
from lexiframe.functions.hashing import assign_split
from lexiframe.operators.vectors import scores_by_table, vector_width
from lexiframe.plans.layout import new_path, spread
from lexiframe.sources import corpus as src
from lexiframe.sources.tables import table

CLASSES = 10  # of the made-up predictions and votes
PLAN_CLASSES = 256  # more classes than this are scored by a table of weights


def word_pairs(spark, folder):
    """Each benchmark word with the one after it in its item."""
    items = spread(table(spark, folder, "benchmark").select("item_id", "text"), "item_id")
    words = items.select("item_id", tx.word_list(F.col("text")).alias("words"))
    following = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice("words", 1, F.size(following)).alias("source"),
                         following.alias("target"))
    each = words.select("item_id", F.posexplode_outer(pairs).alias("pos", "pair"))
    return each.filter(F.col("pair").isNotNull()).select(
        "item_id", "pos", "pair.source", "pair.target")


def joined_ids(text, name):
    return F.array_join(ch.char_ids(text), " ").alias(name)


def char_frames(spark, folder):
    source, target = F.col("source"), F.col("target")
    return word_pairs(spark, folder).select(
        "item_id", "pos", joined_ids(source, "input"),
        joined_ids(ch.char_output(target), "output"),
        joined_ids(ch.char_target(target), "target_ids"),
        joined_ids(ch.char_filler(source), "filler"))


def char_decode(spark, folder):
    """Ids back to text: targets have an end symbol, inputs have none."""
    both = word_pairs(spark, folder).select("item_id", "pos", F.inline_outer(F.array(
        F.struct(F.lit("target").alias("side"), ch.char_ids(ch.char_target(F.col("target"))).alias("ids")),
        F.struct(F.lit("source").alias("side"), ch.char_ids(F.col("source")).alias("ids")))))
    decoded = both.withColumn("decoded", ch.decode_chars(F.col("ids")))
    return decoded.select(
        "item_id", "pos", "side", ch.before_end(F.col("decoded")).alias("word"),
        ch.has_end(F.col("decoded")).alias("ended"))


def char_rewrite(spark, folder):
    items = table(spark, folder, "benchmark")
    line = F.translate(F.col("text"), "\r\n", "  ")
    return items.select("item_id", F.array_join(ch.rewrite_as_chars(line), " ").alias("chars"))


def line_splits(spark, folder):
    """Benchmark items written as lines per split, read back in word and char form."""
    items = table(spark, folder, "benchmark")
    part = F.when(assign_split(F.col("item_id"), "0123") == "test", "test").when(
        assign_split(F.col("item_id"), "45") == "test", "valid").otherwise("train")
    path = new_path(spark, "line_splits")
    src.write_lines(items.select(part.alias("split"), F.translate("text", "\r\n", "  ").alias("line")),
                    path)
    lines = src.read_lines(spark, {s: f"{path}/split={s}" for s in ("train", "valid", "test")})
    n_words, n_chars = F.size(src.line_words(F.col("line"))), F.size(src.line_chars(F.col("line")))
    return lines.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(n_words).alias("n_words"),
        F.sum(n_chars).alias("n_chars"))


def _embeddings(spark, folder):
    return spread(table(spark, folder, "embeddings"), "vec_id")


def one_hot_labels(spark, folder):
    """As many classes as the labels need."""
    given = _embeddings(spark, folder)
    classes = (given.agg(F.max("label")).first()[0] or 0) + 1
    hot = sq.one_hot(F.col("label"), classes)
    return given.select("vec_id", F.posexplode_outer(hot).alias("class", "hot"))


def vector_argmax(spark, folder):
    return _embeddings(spark, folder).select(
        "vec_id", "label", sq.argmax(F.col("embedding")).alias("argmax"))


def vector_softmax(spark, folder):
    soft = _embeddings(spark, folder).select(
        "vec_id", F.posexplode_outer(sq.softmax(F.col("embedding"))).alias("dim", "p"))
    return soft.withColumn("p", F.round("p", 6))


def vector_grid(spark, folder):
    """Rows of the grid, the squarest the vectors' width allows, and its columns."""
    given = _embeddings(spark, folder)
    width = vector_width(given, "embedding")
    n_rows = max((r for r in range(1, width + 1) if width % r == 0 and r * r <= width), default=1)
    n_cols = width // n_rows
    grid = sq.to_grid(F.col("embedding"), n_rows, n_cols)
    grids = given.select("vec_id", F.inline_outer(F.array(
        F.struct(F.lit("rows").alias("view"), grid.alias("grid")),
        F.struct(F.lit("cols").alias("view"), sq.transpose(grid, n_cols).alias("grid")))))
    rows = grids.select("vec_id", "view", F.posexplode_outer("grid").alias("row", "cells"))
    return rows.select("vec_id", "view", "row", F.posexplode_outer("cells").alias("col", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6))


def class_centers(vectors):
    """`label, center, bias` of the nearest-center rule, for the labels there are."""
    averages = ", ".join(f"avg(cast(embedding[{i}] AS double))"
                         for i in range(vector_width(vectors, "embedding")))
    means = vectors.groupBy("label").agg(F.expr(f"array({averages})").alias("center"))
    return means.withColumn("bias", -sq.squared_norm(F.col("center")) / 2)


def vector_scores(spark, folder, plan_classes=PLAN_CLASSES):
    """Linear scores of every vector; weights and bias of the nearest-center rule.

    Weights of a few classes ride in the plan; those of more are a table.
    """
    given = _embeddings(spark, folder)
    centers = class_centers(given)
    if given.select("label").distinct().count() > plan_classes:
        scores = scores_by_table(given.select("vec_id", F.col("embedding").alias("vector")), "vec_id",
                                 centers.select(F.col("label").alias("class"), "center", "bias"))
    else:
        found = centers.orderBy("label").collect()
        labels = F.array(*[F.lit(r["label"]) for r in found])
        each = sq.linear_scores(F.col("embedding"), [r["center"] for r in found], [r["bias"] for r in found])
        scores = given.select("vec_id", F.posexplode_outer(each).alias("_place", "score")).select(
            "vec_id", F.get(labels, F.col("_place")).alias("class"), "score")
    return scores.withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (
    char_frames, char_decode, char_rewrite, line_splits, one_hot_labels, vector_argmax,
    vector_softmax, vector_grid, vector_scores)}
