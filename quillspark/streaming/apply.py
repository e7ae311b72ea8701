"""Fitted models on streams. Every `transform` is a projection or an Arrow batch function, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is stated, as streams must not guess it."""
    return spark.readStream.schema(schema).parquet(folder)


def apply_models(stream: DataFrame, *models) -> DataFrame:
    """The models' transforms one after another."""
    for model in models:
        stream = model.transform(stream)
    return stream


def write_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder with a checkpoint; takes what is there now and stops."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
