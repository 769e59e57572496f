"""An extension of ours: a folder of images as a stream. New files are decoded and summarised as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import alpha_stats
from ..sources.images import decode, to_pixels


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.png", files_a_trigger: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return decode(files)


def run_operator(images: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies ``sink(pixels, batch_id)`` to each micro-batch; a sink keyed by batch_id makes it exactly once."""
    return images.writeStream.foreachBatch(lambda df, batch: sink(to_pixels(df), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes the alpha statistics of a batch, replacing that batch's folder on a rerun."""
    return lambda pixels, batch: alpha_stats(pixels).write.mode("overwrite").parquet(f"{path}/batch={batch}")
