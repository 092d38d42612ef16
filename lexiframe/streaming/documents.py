"""Clean and index documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexiframe.operators import corpus, vocabulary

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                   files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(DOCUMENT_SCHEMA).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def index_stream(documents: DataFrame, vocab: DataFrame, remove_stopwords: bool = True,
                 spread_to: int | None = None) -> DataFrame:
    """The batch operators on a stream, joined to the static vocabulary.

    `spread_to` spreads the few files of a small trigger over more tasks.
    """
    if spread_to:
        documents = documents.repartition(spread_to, "doc_id")
    toks = corpus.tokens(corpus.sentences(documents, remove_stopwords))
    return vocabulary.word_ids(toks, vocab).select("doc_id", "sent_id", "pos", "id")


def run_index(documents: DataFrame, vocab: DataFrame, output: str, checkpoint: str,
              spread_to: int | None = None) -> None:
    """Process what has arrived and stop; a later run takes only what is new."""
    query = (index_stream(documents, vocab, spread_to=spread_to).writeStream.format("parquet")
             .option("path", output).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
