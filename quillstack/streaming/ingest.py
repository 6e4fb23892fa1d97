"""Incremental ingest: a folder of files as a stream of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack.operators import segment
from quillstack.sources import ingest


def stream_files(spark: SparkSession, path: str, glob: str = "*.{md,markdown,txt,text}") -> DataFrame:
    """Enriched documents of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    raw = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("byte_length"))
    return ingest.enriched(raw)


def append_spans(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each document's spans, with heading paths, to a Parquet table; runs over what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        segment.spans(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
