"""Viewsheds by sectors around the observer."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid
from gridweft.ship import ship

SECTORS = 64


def _seen(grid: Grid, row: int, col: int):
    """Of a sector's own cells: 1 for seen, 0 for hidden ones. All samples of a step are taken together, hidden targets leave."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r, c, z = (table[name].to_numpy() for name in ("row", "col", "value"))
        own, eye = np.flatnonzero(table["own"].to_numpy(zero_copy_only=False)), table["eye"][0].as_py()
        top, left = r.min(), c.min()
        ground = np.full((r.max() - top + 2, c.max() - left + 2), np.nan)
        ground[r - top, c - left] = z
        # beyond the last row and column of the grid its edge goes on
        if c.max() == grid.width - 1:
            ground[:, -1] = ground[:, -2]
        if r.max() == grid.height - 1:
            ground[-1] = ground[-2]
        dr, dc = (r[own] - row).astype(np.float64), (c[own] - col).astype(np.float64)
        length, steps = np.hypot(dr, dc), np.maximum(np.abs(dr), np.abs(dc)).astype(np.int64)
        seen = np.ones(len(own))
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = (z[own] - eye) / length
        left_ = np.flatnonzero(steps > 1)
        for step in range(1, int(steps.max(initial=0))):
            left_ = left_[steps[left_] > step]
            along = step / steps[left_]
            y, x = row + dr[left_] * along, col + dc[left_] * along
            y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
            down, right, y0, x0 = y - y0, x - x0, y0 - top, x0 - left
            level = ground[y0, x0] * ((1 - down) * (1 - right)) + ground[y0, x0 + 1] * ((1 - down) * right) + ground[y0 + 1, x0] * (down * (1 - right)) + ground[y0 + 1, x0 + 1] * (down * right)
            hidden = (level - eye) / (length[left_] * along) > angle[left_]  # never beside missing data
            seen[left_[hidden]] = 0.0
            left_ = left_[~hidden]
        return pa.table({"raster_id": pa.array([key[0].as_py()] * len(own), pa.string()), "row": r[own].astype(np.int32), "col": c[own].astype(np.int32), "value": seen})

    return run


def viewshed(cells: DataFrame, grid: Grid, row: int, col: int, height: float, radius: float, sectors: int = SECTORS) -> DataFrame:
    """1 for cells seen from the observer, 0 for hidden ones; no data beyond the radius or where there is none.

    A target is hidden if a sample on the way stands above its line of sight. Samples stand at
    whole steps of the longer span and are bilinear; one next to missing data hides nothing.
    Sight lines of a sector around the observer stay in it, so each sector is one task's, which
    gets the sector's cells and those within a cell and a half of it; only cells near the
    observer go to many.
    """
    ship(cells.sparkSession)
    reach = int(radius / grid.cell_size) + 2
    frame = cells.select("raster_id", "row", "col")
    # the box that sight lines can cross, before any shuffle
    near = cells.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach) & F.col("value").isNotNull())
    observer = near.where((F.col("row") == row) & (F.col("col") == col)).select("raster_id", (F.col("value") + height).alias("eye"))
    dr, dc = F.col("row") - F.lit(float(row)), F.col("col") - F.lit(float(col))
    width = 2 * math.pi / sectors
    place = F.floor(F.atan2(dr, dc) / width)
    # a sample's four cells lie less than the square root of two from it
    half = F.when(F.hypot(dr, dc) > 1.5, F.asin(F.least(F.lit(1.0), F.lit(1.5) / F.hypot(dr, dc)))).otherwise(math.pi)
    low, high = F.floor((F.atan2(dr, dc) - half) / width), F.floor((F.atan2(dr, dc) + half) / width)
    high = F.least(high, low + (sectors - 1))
    spread = near.select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), F.pmod(place, F.lit(sectors)).alias("mine"), (F.hypot(dr, dc) <= radius / grid.cell_size).alias("inside"), F.explode(F.sequence(low, high)).alias("at"))
    dealt = spread.withColumn("sector", F.pmod("at", F.lit(sectors)).cast("int")).join(F.broadcast(observer), "raster_id")  # a number for each raster
    dealt = dealt.select("raster_id", "sector", "row", "col", "value", "eye", (F.col("inside") & (F.col("mine") == F.col("sector"))).alias("own"))
    seen = dealt.groupBy("raster_id", "sector").applyInArrow(_seen(grid, row, col), "raster_id string, row int, col int, value double")
    return frame.join(seen, ["raster_id", "row", "col"], "left")
