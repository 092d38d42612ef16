"""Registered queries of the text-pipeline operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import (conversations, licences, oracle, pattern_packing, pii, quality_model, toxicity,
                           whitening)
from lexiframe.llm.bpe import encode
from lexiframe.llm.line_dedup import dedup_lines
from lexiframe.llm.near_dup import near_groups
from lexiframe.llm.packing import pack
from lexiframe.llm.quality_rules import quality_rules
from lexiframe.llm.search import search
from lexiframe.sources.tables import table


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole text: base counts and digest, and all spans."""
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.BASE],
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines that an earlier line repeats, up to one edit."""
    rows = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), counts=True)
    return rows.select("doc_id", "n_lines", "n_kept",
                       F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


def op3_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into windows of 1024 tokens with its neighbours."""
    pieces = pack(table(spark, folder, "documents"), VOCABULARY)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    rows = encode(table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY)
    return rows.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by the weakly labelled quality model."""
    return quality_model.score(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op6_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the id of its near-duplicate class."""
    groups = near_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "class_id")


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's canonical digest and the licences found in it."""
    return licences.scan(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's category probabilities and verdict."""
    docs = table(spark, folder, "documents")
    chain = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), chain).drop("text")


def op9_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20."""
    return search(table(spark, folder, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(table(spark, folder, "documents")).drop("class_distance", "word_distance")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on the leading components, whitened."""
    white = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    per = lambda values: F.element_at(F.lit(values).cast("array<double>"), F.col("component"))
    return white.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(white.n).cast("long").alias("n"), "deviation",
        "whitened", F.col("place").alias("at")).withColumn("explained", per(white.explained)).withColumn(
        "identity_error", F.lit(white.identity_error)).drop("at")


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's faults, cheapest edits and the digest of its repaired turns."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.reports(conversations.repair(conversations.damage(rows)))
    ids = rows.select("conv_id").distinct().withColumn("conv", conversations.key_of("conv_id"))
    found = found.withColumn("conv", conversations.key_of("conv_id")).drop("conv_id")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversations.TOTALS]
    return ids.join(found, "conv", "left").select(
        "conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into windows of 4096 tokens by patterns of lengths."""
    pieces = pattern_packing.pack(table(spark, folder, "documents"), WORD_VOCABULARY)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op1_pii": op1_pii, "op2_line_dedup": op2_line_dedup,
           "op3_retrieval_packing": op3_retrieval_packing, "op4_bpe": op4_bpe,
           "op5_quality_model": op5_quality_model, "op6_bagminhash": op6_bagminhash,
           "op7_licences": op7_licences, "op8_toxicity": op8_toxicity,
           "op9_block_max_search": op9_block_max_search,
           "op10_quality_rules": op10_quality_rules, "op11_whitening": op11_whitening,
           "op12_conversations": op12_conversations, "op13_pattern_packing": op13_pattern_packing}
ORACLE = {"op2_line_dedup": oracle.LINE_DEDUP, "op7_licences": oracle.licences(),
          "op10_quality_rules": oracle.QUALITY_RULES, "op12_conversations": oracle.conversations()}
