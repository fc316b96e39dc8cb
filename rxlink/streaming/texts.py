"""An optional streaming front end: recognised texts arriving as files become records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rxlink.operators.records import extract_records
from rxlink.sources.lookups import Lookups


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON rows (source_image, text) as they arrive."""
    return spark.readStream.schema("source_image string, text string").json(folder)


def write_records(stream: DataFrame, lk: Lookups, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the batch plan; an image's text arrives whole."""

    def batch(df: DataFrame, number: int) -> None:
        extract_records(df, lk).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
