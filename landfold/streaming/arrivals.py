"""Scenes that arrive later, as a stream of pixel files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landfold.keys import K
from landfold.operators.bands import spectral_bands


def scene_summaries(pixels: DataFrame) -> DataFrame:
    """(site_id, scene_id, pixels, lum, chroma, grayscale): running means over the pixels that have arrived."""
    b = spectral_bands(pixels)
    return b.groupBy(*K).agg(F.count(F.lit(1)).alias("pixels"), F.avg("lum").alias("lum"), F.avg("chroma").alias("chroma"), (F.avg("chroma") < 3).alias("grayscale"))


def arriving_pixels(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, of the columns of ``scene_pixels``."""
    return spark.readStream.schema(schema).parquet(path)


def keep_summaries(pixels: DataFrame, target: str, checkpoint: str):
    """Write the summaries of all that is there now and end; a later call with the same checkpoint adds what came since.

    Each batch's full table goes to a folder of its own, so that a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return scene_summaries(pixels).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_summaries(spark: SparkSession, target: str) -> DataFrame:
    t = spark.read.parquet(target)
    return t.join(t.agg(F.max("batch").alias("batch")), "batch").drop("batch")
