"""Flat arrays of vectors and zone rows, and named functions over row-major values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid, InvalidInput, from_values, values
from gridweft.operators import algebra, focal, hydro, terrain, vector, zonal


def _points(column: str):
    return F.flatten(F.transform(column, lambda p: F.array(p["x"], p["y"])))


def flat_contours(lines: DataFrame) -> DataFrame:
    """[level, vertices, x, y, ...] of each line."""
    return lines.select("raster_id", "level", "line_id", F.concat(F.array("level", F.size("vertices").cast("double")), _points("vertices")).alias("flat"))


def flat_polygons(polygons: DataFrame) -> DataFrame:
    """[value, rings, (vertices, x, y, ...) of each ring] of each polygon."""
    ring = F.transform("rings", lambda r: F.concat(F.array(F.size(r).cast("double")), F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"])))))
    return polygons.withColumn("flat", F.concat(F.array(F.col("value"), F.size("rings").cast("double")), F.flatten(ring)))


def read_flat_polygons(flat: list[float]) -> list[tuple[float, list[list[tuple[float, float]]]]]:
    """(value, rings) of polygons that stand one after the other."""
    out, at = [], 0
    try:
        while at < len(flat):
            value, rings, n = flat[at], [], int(flat[at + 1])
            at += 2
            for _ in range(n):
                size = int(flat[at])
                body = flat[at + 1 : at + 1 + 2 * size]
                if len(body) != 2 * size:
                    raise IndexError
                rings.append(list(zip(body[::2], body[1::2], strict=True)))
                at += 1 + 2 * size
            out.append((value, rings))
    except IndexError:
        raise InvalidInput("a flat polygon ends too soon") from None
    return out


class RasterFunctions:
    """Functions of small grids given and returned as row-major lists, for notebooks and bindings."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _grid(self, data: list, width: int, height: int, nodata: float) -> DataFrame:
        return from_values(self.spark, data, width, height, nodata)

    def hillshade(self, data, width, height, cell_size, nodata, azimuth, altitude):
        return values(terrain.hillshade(self._grid(data, width, height, nodata), cell_size, azimuth, altitude))

    def slope(self, data, width, height, cell_size, nodata):
        return values(terrain.slope(self._grid(data, width, height, nodata), cell_size))

    def aspect(self, data, width, height, cell_size, nodata):
        return values(terrain.aspect(self._grid(data, width, height, nodata), cell_size))

    def fill_sinks(self, data, width, height, cell_size, nodata):
        return values(hydro.fill_sinks(self._grid(data, width, height, nodata), Grid(width, height, cell_size)))

    def reclassify(self, data, width, height, nodata, classes):
        if len(classes) % 3:
            raise InvalidInput("classes are triples of min, max and value")
        return values(algebra.reclassify(self._grid(data, width, height, nodata), list(zip(classes[::3], classes[1::3], classes[2::3], strict=True))))

    def apply_unary(self, data, width, height, nodata, op, constant=0.0):
        return values(algebra.apply_unary(self._grid(data, width, height, nodata), op, constant))

    def apply_binary(self, a, b, width, height, nodata, op):
        return values(algebra.apply_binary(self._grid(a, width, height, nodata), self._grid(b, width, height, nodata), op))

    def normalized_difference(self, a, b, width, height, nodata):
        return values(algebra.normalized_difference(self._grid(a, width, height, nodata), self._grid(b, width, height, nodata), 0.0))

    def contours(self, data, width, height, cell_size, nodata, interval, base):
        lines = vector.contour_lines(self._grid(data, width, height, nodata), Grid(width, height, cell_size), interval, base)
        return [x for r in flat_contours(lines).orderBy("level", "line_id").collect() for x in r["flat"]]

    def polygonize(self, data, width, height, cell_size, nodata):
        found = vector.polygonize(self._grid(data, width, height, nodata), Grid(width, height, cell_size))
        return [x for r in flat_polygons(found).orderBy("region", "poly").collect() for x in r["flat"]]

    def focal_stats(self, data, width, height, nodata, radius, shape, stat):
        return values(focal.focal_stats(self._grid(data, width, height, nodata), radius, shape, stat))

    def zonal_stats(self, data, zones, width, height, nodata):
        rows = zonal.zonal_stats(self._grid(data, width, height, nodata), self._grid(zones, width, height, nodata)).orderBy("zone").collect()
        return [float(r[c]) for r in rows for c in ("zone", "count", "min", "max", "mean", "sum", "std", "median")]

    def rasterize(self, flat, width, height, bbox, nodata=None):
        if len(bbox) != 4:
            raise InvalidInput("a box is xmin, ymin, xmax, ymax")
        shapes = [(k, float(v), [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, (v, rings) in enumerate(read_flat_polygons(flat))]
        table = self.spark.createDataFrame(shapes, f"poly_ord int, value double, rings array<{vector._POINT}>")
        return values(vector.rasterize(table, Grid(width, height), tuple(bbox)))

    def write_cog(self, bands, width, height, path, nodata, grid=None, sample_format="f64", tile_size=256, overviews=4, deflate=False):
        """Bands as lists of row-major values, to one file of square tiles."""
        from gridweft.functions.grid import banded
        from gridweft.sources.spark import write_cog

        cells = banded([self._grid(b, width, height, nodata) for b in bands])
        write_cog(cells, path, grid or Grid(width, height), len(bands), sample_format, (tile_size, tile_size), overviews, deflate, nodata)
