"""Running composites of layers that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_layers(spark, path: str, max_files: int = 100) -> DataFrame:
    """A stream of cells (raster_id, row, col, value, ts) from Parquet files as they arrive."""
    return spark.readStream.schema("raster_id string, row int, col int, value double, ts timestamp").option("maxFilesPerTrigger", max_files).parquet(path)


def running_composite(layers: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, least, greatest and count of each cell's data by window of ts; layers later than `late` are dropped."""
    return layers.withWatermark("ts", late).groupBy("raster_id", "row", "col", F.window("ts", window).alias("w")).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")).select("raster_id", "row", "col", F.col("w.start").alias("start"), "mean", "min", "max", "n")
