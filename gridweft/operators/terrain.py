"""Slope, aspect, hillshade and flow direction from 3x3 neighbourhoods.

Neighbours come from two windows, along rows and then along columns, so a grid is shuffled
twice and never joined with itself. Grids must be dense (see densify).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import cols_window, rows_window

#: D8 codes in the order in which equal drops are decided, with their (row, col) steps.
D8 = ((1, 0, 1, "e"), (2, 1, 1, "se"), (4, 1, 0, "s"), (8, 1, -1, "sw"), (16, 0, -1, "w"), (32, -1, -1, "nw"), (64, -1, 0, "n"), (128, -1, 1, "ne"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Adds nw n ne w e sw s se; NULL outside the grid and where there is no data."""
    along = cells.withColumn("w", F.lag("value").over(rows_window())).withColumn("e", F.lead("value").over(rows_window()))
    down = cols_window()
    for name, source in (("n", "value"), ("nw", "w"), ("ne", "e")):
        along = along.withColumn(name, F.lag(source).over(down))
    for name, source in (("s", "value"), ("sw", "w"), ("se", "e")):
        along = along.withColumn(name, F.lead(source).over(down))
    return along


def gradient(cells: DataFrame, cell_size: float) -> DataFrame:
    """Adds dx and dy by Horn's weights; NULL unless all eight neighbours have data. The centre isn't used."""
    c = F.col
    dx = ((c("ne") + c("e") * 2 + c("se")) - (c("nw") + c("w") * 2 + c("sw"))) / (8 * cell_size)
    dy = ((c("sw") + c("s") * 2 + c("se")) - (c("nw") + c("n") * 2 + c("ne"))) / (8 * cell_size)
    whole = c("nw").isNotNull() & c("n").isNotNull() & c("ne").isNotNull() & c("w").isNotNull() & c("e").isNotNull() & c("sw").isNotNull() & c("s").isNotNull() & c("se").isNotNull()
    return neighbours(cells).withColumn("dx", F.when(whole, dx)).withColumn("dy", F.when(whole, dy)).drop("nw", "n", "ne", "w", "e", "sw", "s", "se")


def slope(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Steepness in degrees."""
    rise = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return gradient(cells, cell_size).withColumn("value", F.degrees(F.atan(rise))).drop("dx", "dy")


def aspect(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Downhill bearing in degrees clockwise from north; flat cells are no data."""
    bearing = F.pmod(F.lit(90.0) - F.degrees(F.atan2(F.col("dy"), -F.col("dx"))), F.lit(360.0))
    sloped = (F.col("dx") != 0) | (F.col("dy") != 0)
    return gradient(cells, cell_size).withColumn("value", F.when(sloped, bearing)).drop("dx", "dy")


def hillshade(cells: DataFrame, cell_size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, standard: bool = False) -> DataFrame:
    """Shade from 0 to 255.

    By default altitude weighs flat ground by its cosine and the azimuth is taken as it is;
    standard=True gives the usual cartographic form.
    """
    rise = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    alt, az = math.radians(altitude), math.radians(azimuth)
    facing = F.atan2(F.col("dy"), -F.col("dx"))
    flat, steep = (math.sin(alt), math.cos(alt)) if standard else (math.cos(alt), math.sin(alt))
    light = math.radians((450.0 - azimuth) % 360.0) if standard else az
    shade = (F.cos(rise) * flat + F.sin(rise) * steep * F.cos(F.lit(light) - facing)) * 255.0
    return gradient(cells, cell_size).withColumn("value", F.when(shade.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), shade)))).drop("dx", "dy")


def flow_direction(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """D8 code of the steepest drop per distance, the first of equal ones from east clockwise; 0 without any."""
    drops = []
    for _, dr, dc, name in D8:
        distance = cell_size * (math.sqrt(2.0) if dr and dc else 1.0)
        drops.append(F.coalesce((F.col("value") - F.col(name)) / distance, F.lit(0.0)))
    best = F.greatest(*drops)
    code = F.when(best <= 0, F.lit(0.0))
    for (number, *_), drop in zip(D8, drops, strict=True):
        code = code.when(drop == best, F.lit(float(number)))
    return neighbours(cells).withColumn("value", F.when(F.col("value").isNotNull(), code)).drop(*[d[3] for d in D8])
