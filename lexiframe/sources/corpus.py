"""Labelled TSV, one-sentence-per-line text and inline pair tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiframe.functions.chars import rewrite_as_chars
from lexiframe.plans.layout import written

CORRUPT = "_corrupt"
# Column names of a labelled corpus file.
FILE_SCHEMA = f"class int, news string, {CORRUPT} string"
FORMAT = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
SPLIT = ["file", "block", "size"]  # a file, and where a task's part of it begins and how long it is


def read_corpus(spark: SparkSession, path: str, split: str,
                multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """`split, label, text, _corrupt` of tab-separated files, each with a header.

    Quoted fields may hold tabs and line ends; large files are read by many tasks all the same, see
    `quoted_records`. A quote mark within an unquoted field is corrupt then; with `whole_files` it
    is an ordinary character, but a file is one task. Pass `multiline=False` for files known to
    hold one record per line: their text does not move.
    """
    if multiline and not whole_files:
        records = quoted_records(spark, path)
        parsed = F.from_csv("record", FILE_SCHEMA, FORMAT | {"multiLine": "true"})
        rows = records.select("record", parsed.alias("row")).select("row.class", "row.news", F.when(
            misquoted(F.col("record")), F.col("record")).otherwise(F.col(f"row.{CORRUPT}")).alias(CORRUPT))
    else:
        rows = spark.read.schema(FILE_SCHEMA).options(**FORMAT, header=True, multiLine=multiline).csv(path)
    return rows.select(F.lit(split).alias("split"), F.col("class").alias("label"),
                       F.col("news").alias("text"), CORRUPT)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """`record` of delimited files whose quoted fields may hold line ends, without the headers.

    A line end lies in a field if an odd number of quote marks stands before it in the file. The
    marks are counted per split of the scan first; running sums over a file's splits tell where each
    one starts, and the lines that end a field opened in an earlier split go there. So the text
    is scanned twice and moves once, and no task holds more than a split and the end of its last
    record. Lines end as the first one of their file does, with a line feed or a carriage return
    and a line feed; in a field either end becomes a line feed, a carriage return in a file
    of line feeds stays. Empty lines between records are no records. A file whose last field is
    never closed ends in one long record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("size"), F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"))
    marks = F.length("line") - F.length(F.replace("line", F.lit('"')))
    splits = lines.groupBy(*SPLIT).agg(
        F.sum(marks).alias("marks"), F.max("place").alias("last"), F.count_if(~F.col("line").isin("", "\r")).alias("n_filled"),
        F.min(F.when(marks % 2 == 1, F.col("place"))).alias("closes"),
        F.min_by(F.endswith("line", F.lit("\r")), "place").alias("returns"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = ~F.col("inside") | (F.col("last") > F.col("closes"))  # a record begins in the split
    splits = (splits.withColumn("split", F.monotonically_increasing_id())
              .withColumn("inside", F.coalesce(F.sum("marks").over(earlier), F.lit(0)) % 2 == 1)
              .withColumn("from", F.max(F.when(begins, F.struct("block", "split"))).over(earlier)["split"])
              .withColumn("first", F.min(F.when(F.col("n_filled") > 0, F.struct("block", "split"))).over(whole)["split"])
              .withColumn("returns", F.min_by("returns", "block").over(whole))
              .select(*SPLIT, "split", "inside", "closes", "from", "first", "returns"))
    known = F.coalesce("inside", F.raise_error(F.lit(
        "the files were split in two ways: set spark.sql.files.minPartitionNum")).cast("boolean"))
    carried = known & (F.col("closes").isNull() | (F.col("place") <= F.col("closes")))
    home = F.when(carried, F.col("from")).otherwise(F.col("split"))  # a number, not the file's long name
    line = F.when(F.col("returns"), F.regexp_replace("line", "\r\\z", "")).otherwise(F.col("line"))
    placed = lines.join(written(splits, "quoted_splits"), SPLIT, "left").select(
        home.alias("home"), "block", "place", (home == F.col("first")).alias("headed"), line.alias("line"), marks.alias("marks"))
    home = Window.partitionBy("home").orderBy("block", "place")
    opened = F.coalesce(F.sum("marks").over(home.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    numbered = (placed.withColumn("opened", opened).filter(F.col("opened") | (F.col("line") != ""))
                .withColumn("number", F.sum(F.when(F.col("opened"), 0).otherwise(1)).over(
                    home.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "line")))
    return (numbered.filter(~F.col("headed") | (F.col("number") > 1))  # the header
            .groupBy("home", "number").agg(parts.alias("parts"))
            .select(F.array_join("parts.line", "\n").alias("record")))


def misquoted(record: Column) -> Column:
    """Whether a quoted part begins within a field instead of at its start."""
    return F.regexp_replace(record, '"[^"]*"', '"').rlike('[^\t"]"')


def is_bad() -> Column:
    return F.col(CORRUPT).isNotNull() | F.col("label").isNull() | F.col("text").isNull()


def good_rows(corpus: DataFrame) -> DataFrame:
    return corpus.filter(~is_bad()).drop(CORRUPT)


def bad_rows(corpus: DataFrame) -> DataFrame:
    """Rows that do not parse or lack a label or text."""
    return corpus.filter(is_bad())


def with_doc_id(corpus: DataFrame) -> DataFrame:
    """Give each row an id. Write the result before use: the id is fixed then."""
    return corpus.withColumn("doc_id", F.monotonically_increasing_id())


def write_corpus(corpus: DataFrame, path: str) -> None:
    (corpus.select(F.col("label").alias("class"), F.col("text").alias("news"))
     .write.option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """`split, line` from one text path per split."""
    frames = [spark.read.text(path).select(F.lit(split).alias("split"), F.col("value").alias("line"))
              for split, path in paths.items()]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text, one folder `split=...` per split."""
    lines.select("split", F.col("line").alias("value")).write.partitionBy("split").text(path)


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(line, " +"), "")


def line_chars(line: Column) -> Column:
    return rewrite_as_chars(line)


def pair_table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """A small inline table of (source, target) texts."""
    return spark.createDataFrame(list(pairs), "source string, target string")
