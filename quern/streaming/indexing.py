"""An index that grows with a stream of documents: each micro-batch becomes a segment, and readers merge segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.index import inverted_index, merge, occurrences, save_postings


def index_stream(docs: DataFrame, path: str, checkpoint: str, **flags: object) -> StreamingQuery:
    """Write each batch's postings to ``path/segment=<batch>``; a batch that is run again overwrites its own segment."""

    def segment(batch: DataFrame, number: int) -> None:
        save_postings(inverted_index(occurrences(batch, **flags)), f"{path}/segment={number}")

    return docs.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The postings of all segments as one index; filters on the term reach the scan."""
    return merge(spark.read.parquet(path).drop("segment"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the merged segments as one, so that reads needn't merge any more."""
    save_postings(read_segments(spark, path), to)
