"""Grids as tables of cells: (raster_id, row, col, value), one row a cell, NULL where there is no data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = ["raster_id", "row", "col"]
SCHEMA = "raster_id string, row int, col int, value double"


class GridError(ValueError):
    """Base of the library's errors."""


class DimensionMismatch(GridError):
    pass


class IncompatibleRasters(GridError):
    pass


class InvalidInput(GridError):
    pass


class FormatError(GridError):
    pass


@dataclass(frozen=True)
class Grid:
    """Geometry of a grid: row 0 is north, origin is its top-left corner, pixel sizes are positive."""

    width: int
    height: int
    cell_size: float = 1.0
    origin_x: float = 0.0
    origin_y: float = 0.0
    pixel_width: float = 1.0
    pixel_height: float = 1.0
    epsg: int = 4326

    def same_shape(self, other: Grid) -> bool:
        return (self.width, self.height) == (other.width, other.height)

    def coarser(self, factor: int) -> Grid:
        return replace(self, width=-(-self.width // factor), height=-(-self.height // factor), cell_size=self.cell_size * factor, pixel_width=self.pixel_width * factor, pixel_height=self.pixel_height * factor)


def need_same_shape(a: Grid | None, b: Grid | None, error=IncompatibleRasters) -> None:
    if a and b and not a.same_shape(b):
        raise error(f"{a.width}x{a.height} against {b.width}x{b.height}")


def clean(value: Column, nodata: float | None = None) -> Column:
    """value with NaN and the sentinel as NULL."""
    value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value if nodata is None or nodata != nodata else F.when(value != nodata, value)


def blank(spark: SparkSession, grid: Grid, raster_id: str = "0") -> DataFrame:
    """A grid without data."""
    cells = spark.range(grid.width * grid.height)
    return cells.select(F.lit(raster_id).alias("raster_id"), F.floor(F.col("id") / max(1, grid.width)).cast("int").alias("row"), (F.col("id") % max(1, grid.width)).cast("int").alias("col"), F.lit(None).cast("double").alias("value"))


def from_values(spark: SparkSession, values: list, width: int, height: int, nodata: float | None = None, raster_id: str = "0") -> DataFrame:
    """A grid of row-major values."""
    if len(values) != width * height:
        raise DimensionMismatch(f"{len(values)} values for {width}x{height} cells")
    rows = [(raster_id, k // width, k % width, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("value", clean(F.col("value"), nodata))


def values(cells: DataFrame) -> list:
    """Row-major values of one small grid, on the driver."""
    return [r["value"] for r in cells.orderBy("row", "col").select("value").collect()]


def densify(cells: DataFrame, grid: Grid) -> DataFrame:
    """All cells of the grid for every raster, absent ones NULL."""
    ids = cells.select("raster_id").distinct()
    frame = ids.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid.height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))))
    return frame.join(cells, CELL, "left")


def cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def with_cell(cells: DataFrame, row: int, col: int, value: float | None) -> DataFrame:
    """The grid with one value changed; a place outside changes nothing."""
    here = (F.col("row") == row) & (F.col("col") == col)
    return cells.withColumn("value", F.when(here, F.lit(value).cast("double")).otherwise(F.col("value")))


def banded(bands: list[DataFrame], grids: list[Grid] | None = None, names: list[str] | None = None) -> DataFrame:
    """Bands of one shape as (raster_id, row, col, value, band, name)."""
    if not bands:
        raise InvalidInput("a banded raster has one band at least")
    if names is not None and len(names) != len(bands):
        raise InvalidInput(f"{len(names)} names for {len(bands)} bands")
    for other in (grids or ())[1:]:
        need_same_shape(grids[0], other)
    parts = [b.withColumn("band", F.lit(k)).withColumn("name", F.lit(names[k] if names else None).cast("string")) for k, b in enumerate(bands)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def band_count(cells: DataFrame) -> int:
    return cells.agg(F.coalesce(F.max("band") + 1, F.lit(0))).first()[0]


def band(cells: DataFrame, index: int) -> DataFrame:
    """One band of a banded raster as a grid; an absent band gives no rows."""
    return cells.where(F.col("band") == index).select(*CELL, "value")


def band_names(cells: DataFrame) -> DataFrame:
    """(band, name) of the bands."""
    return cells.groupBy("band").agg(F.max("name").alias("name"))


def with_band(cells: DataFrame, index: int, values: DataFrame) -> DataFrame:
    """The banded raster with other values in one band."""
    new = values.select(*CELL, F.col("value").alias("_new")).withColumn("band", F.lit(index))
    joined = cells.join(new, [*CELL, "band"], "left")
    return joined.withColumn("value", F.when(F.col("band") == index, F.col("_new")).otherwise(F.col("value"))).select(*cells.columns)


def stack(layers: list[DataFrame], timestamps: list[float], grids: list[Grid] | None = None) -> DataFrame:
    """Layers of one shape as (raster_id, row, col, value, t_idx, t); their order is by index, never by time."""
    if not layers or len(layers) != len(timestamps):
        raise InvalidInput(f"{len(layers)} layers and {len(timestamps)} timestamps")
    for other in (grids or ())[1:]:
        need_same_shape(grids[0], other)
    out = None
    for k, (layer, t) in enumerate(zip(layers, timestamps, strict=True)):
        part = layer.withColumn("t_idx", F.lit(k)).withColumn("t", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out


def rows_window() -> Window:
    """Along a row, west to east."""
    return Window.partitionBy("raster_id", "row").orderBy("col")


def cols_window() -> Window:
    """Along a column, north to south."""
    return Window.partitionBy("raster_id", "col").orderBy("row")
