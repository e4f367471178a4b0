"""Images that arrive in a folder, as a stream of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import with_lab


def lab_stream(spark: SparkSession, folder: str, schema: str = "image_id long, y int, x int, r int, g int, b int") -> DataFrame:
    """Lab pixels of Parquet pixel files as they appear in a folder; stateless, so it resumes from its checkpoint."""
    pixels = spark.readStream.schema(schema).parquet(folder)
    return with_lab(pixels.select("image_id", "y", "x", "r", "g", "b"))
