"""Streams of image files and of strokes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelloom.sources import images

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """Streaming (image_id, path, content) of files as they arrive."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.select(F.abs(F.xxhash64("path")).alias("image_id"), "path", "content")


def process(spark: SparkSession, folder: str, target: str, checkpoint: str, chain: Callable[[DataFrame], DataFrame], pattern: str = "*") -> StreamingQuery:
    """Runs a chain on whole images of each batch of new files and writes the result as Parquet, a folder for each batch, so a batch that is run again replaces itself."""

    def batch(contents: DataFrame, number: int) -> None:
        frames = images.decoded(contents).where("data IS NOT NULL")
        chain(frames).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return watch(spark, folder, pattern).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
