"""Resolution pyramids and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid


def overview(cells: DataFrame) -> DataFrame:
    """The grid at half the resolution: means of the data in 2x2 blocks, odd edges by what they have."""
    halves = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("row", "col")]
    return cells.groupBy("raster_id", *halves).agg(F.avg("value").alias("value"))


def generate_overviews(cells: DataFrame, levels: int) -> list[DataFrame]:
    """Overviews of factors 2, 4, 8, ... each from the one before."""
    out = []
    for _ in range(levels):
        cells = overview(cells)
        out.append(cells)
    return out


def extract_tile(cells: DataFrame, grid: Grid, tile_col: int, tile_row: int, tile_width: int, tile_height: int) -> DataFrame:
    """One tile's cells by their place in it; outside the grid there is no data."""
    row, col = F.col("row") - tile_row * tile_height, F.col("col") - tile_col * tile_width
    inside = cells.where((row >= 0) & (row < tile_height) & (col >= 0) & (col < tile_width)).select("raster_id", row.alias("row"), col.alias("col"), "value")
    frame = cells.select("raster_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(tile_height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(tile_width - 1))))
    return frame.join(inside, ["raster_id", "row", "col"], "left")


def window(cells: DataFrame, col0: int, row0: int, cols: int, rows: int) -> DataFrame:
    """The cells of a pixel box, numbered from its corner."""
    here = F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1)
    return cells.where(here).withColumn("row", F.col("row") - row0).withColumn("col", F.col("col") - col0)


def select_level(pixel_widths: list[float], target: float) -> int:
    """The coarsest level whose pixels aren't wider than the target, else the finest."""
    fitting = [k for k, w in enumerate(pixel_widths) if w <= target * (1 + 1e-9)]
    return max(fitting, key=lambda k: pixel_widths[k], default=0)
