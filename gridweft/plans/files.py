"""Registered queries of file formats: grids written to files in the shared folder and read back.

Their oracle SQL is that of the grids which were written.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions import grid as G
from gridweft.functions.rounds import shared_folder
from gridweft.plans import surfaces as S
from gridweft.sources import spark as R
from gridweft.sources.samples import FORMATS, FileWrite
from gridweft.sources.sinks import tiled

QUERIES = {}
ORACLES = {}
TILE = 48
PLACED = dict(origin_x=500_000.0, origin_y=4_500_000.0, pixel_width=10.0, pixel_height=10.0, epsg=32632)


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    R.register(spark)
    return spark.read.format(kind).options(path=path, **options).load()


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


def _cells(df: DataFrame) -> DataFrame:
    return df.select("row", "col", "value")


# -- GeoTIFF --


@_query(f"SELECT row, col, value FROM ({S.SQL_HOLES})")
def read_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """The plain single-band file, holes by its nodata value."""
    path = _file(spark, "plain.tif")
    R.write_geotiff(S.holes(spark, d), path, G.Grid(16, 16, 10.0, **PLACED), plain=True)
    return _cells(_read(spark, "geotiff", path))


@_query(f"SELECT 0 AS band, row, col, tax AS value FROM ({S.SQL_BANDS}) UNION ALL SELECT 1 AS band, row, col, discount AS value FROM ({S.SQL_BANDS})")
def read_geotiff_bands(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "bands.tif")
    R.write_geotiff(G.banded(list(S.bands(spark, d))), path, S.SALES, 2, "u32")
    return _read(spark, "geotiff", path).select("band", "row", "col", "value")


@_query(f"SELECT row, col, value FROM ({S.SQL_PLANE}) WHERE row BETWEEN 20 AND 33 AND col BETWEEN 3 AND 40")
def geotiff_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns given as options; only the strips' rows that hold them are read."""
    path = _file(spark, "plane.tif")
    R.write_geotiff(S.plane(spark, d), path, S.plane_grid(spark, d), 1, "f64", rows_a_block=16)
    return _cells(_read(spark, "geotiff", path, row_min=20, row_max=33, col_min=3, col_max=40))


_RANGES = {name: f.integer_range for name, f in FORMATS.items()}
_SQL_FORMATS = " UNION ALL ".join(
    f"SELECT '{name}' AS format, row, col, " + (f"least({high}, greatest({low}, sign(v) * floor(abs(v) + 0.5)))::DOUBLE" if low is not None else f"v::{'FLOAT' if name == 'f32' else 'DOUBLE'}::DOUBLE") + " AS value FROM g"
    for name, (low, high) in ((n, r or (None, None)) for n, r in _RANGES.items())
)


@_query(f"WITH g AS (SELECT row, col, (value - 800) * 0.75 AS v FROM ({S.SQL_SALES})) {_SQL_FORMATS}")
def sample_formats(spark: SparkSession, d: str) -> DataFrame:
    """One file of each sample format: integers are rounded half away from zero and clamped."""
    cells, out = S.sales(spark, d).withColumn("value", (F.col("value") - 800) * 0.75), None
    for name in FORMATS:
        path = _file(spark, f"{name}.tif")
        R.write_geotiff(cells, path, S.SALES, 1, name)
        part = _read(spark, "geotiff", path).select(F.lit(name).alias("format"), "row", "col", "value")
        out = part if out is None else out.union(part)
    return out


@_query("SELECT 0::INT AS level, 16::INT AS width, 16::INT AS height, 10::DOUBLE AS pixel_width, 500000::DOUBLE AS origin_x, 4500000::DOUBLE AS origin_y, 32632::INT AS epsg, 1::INT AS bands, 'f64' AS sample_format")
def geotiff_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "meta.tif")
    R.write_geotiff(S.sales(spark, d), path, G.Grid(16, 16, 10.0, **PLACED))
    return _read(spark, "geotiff", path, metadata="true").select("level", "width", "height", "pixel_width", "origin_x", "origin_y", "epsg", "bands", "sample_format")


# -- cloud-optimised GeoTIFF --


def _plane_cog(spark: SparkSession, d: str, **options) -> str:
    path = _file(spark, "plane.cog.tif")
    R.write_cog(S.plane(spark, d), path, S.plane_grid(spark, d), tile=(TILE, TILE), overviews=2, **options)
    return path


_SQL_HALF = "SELECT (row // 2)::INT AS row, (col // 2)::INT AS col, avg(value) AS value FROM ({}) GROUP BY 1, 2"


@_query(f"SELECT row, col, value FROM ({S.SQL_PLANE})")
def read_cog(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_read(spark, "cog", _plane_cog(spark, d)))


@_query(f"SELECT row, col, floor(value * 1e6 + 0.5) / 1e6 AS value FROM ({_SQL_HALF.format(S.SQL_PLANE)})")
def read_cog_level(spark: SparkSession, d: str) -> DataFrame:
    found = _cells(_read(spark, "cog", _plane_cog(spark, d, deflate=True), level=1))
    return found.withColumn("value", F.floor(F.col("value") * 1e6 + 0.5) / 1e6)


@_query(f"SELECT row, col, floor(value * 1e6 + 0.5) / 1e6 AS value FROM ({_SQL_HALF.format(_SQL_HALF.format(S.SQL_PLANE))})")
def cog_by_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The coarsest level whose pixels aren't wider than 5: the second overview of pixels of width 1."""
    found = _cells(_read(spark, "cog", _plane_cog(spark, d), resolution=5))
    return found.withColumn("value", F.floor(F.col("value") * 1e6 + 0.5) / 1e6)


@_query(f"SELECT row, col, value FROM ({S.SQL_PLANE}) WHERE row BETWEEN 40 AND 60 AND col BETWEEN 10 AND 50")
def cog_window(spark: SparkSession, d: str) -> DataFrame:
    """A pixel box by options: only the tiles that it touches are fetched."""
    return _cells(_read(spark, "cog", _plane_cog(spark, d), row_min=40, row_max=60, col_min=10, col_max=50))


_SQL_TILES = f"(SELECT ((n - 1) // {TILE} - 50 // {TILE} + 1)::INT FROM (SELECT floor(sqrt(count(*)))::INT AS n FROM lineitem))"


@_query(f"SELECT row, col, value, {_SQL_TILES} AS tiles_read FROM ({S.SQL_PLANE}) WHERE row >= 50 AND col < 20")
def cog_pushed_filters(spark: SparkSession, d: str) -> DataFrame:
    """A pixel box by an ordinary filter: the reader plans the tiles that it touches, a partition each, and no others."""
    found = _cells(_read(spark, "cog", _plane_cog(spark, d), tile_bytes=1).where((F.col("row") >= 50) & (F.col("col") < 20)))
    return found.withColumn("tiles_read", F.lit(found.rdd.getNumPartitions()))


def _saved(cells: DataFrame, kind: str, path: str, grid: G.Grid, mode: str = "overwrite", **options) -> None:
    R.register(cells.sparkSession)
    cells.write.format(kind).mode(mode).options(path=path, width=grid.width, height=grid.height, **options).save()


@_query(f"SELECT 0::INT AS level, row, col, value FROM ({S.SQL_PLANE}) UNION ALL SELECT 1, row, col, floor(value * 1e6 + 0.5) / 1e6 FROM ({_SQL_HALF.format(S.SQL_PLANE)})")
def write_format_cog(spark: SparkSession, d: str) -> DataFrame:
    """df.write.format("cog"), deflated, with an overview; both levels read back."""
    path, grid = _file(spark, "written.cog.tif"), S.plane_grid(spark, d)
    _saved(tiled(S.plane(spark, d), grid, (TILE, TILE), 1), "cog", path, grid, tile_width=TILE, tile_height=TILE, overviews=1, deflate="true")
    levels = [_cells(_read(spark, "cog", path, level=k)).select(F.lit(k).alias("level"), "row", "col", F.floor(F.col("value") * 1e6 + 0.5) / 1e6) for k in (0, 1)]
    return levels[0].union(levels[1]).toDF("level", "row", "col", "value")


@_query(f"SELECT row, col, value FROM ({S.SQL_HOLES})")
def write_format_cog_again(spark: SparkSession, d: str) -> DataFrame:
    """Uncompressed tiles, whose tasks put them in their places; a second file takes the first one's name."""
    path = _file(spark, "again.cog.tif")
    options = dict(tile_width=5, tile_height=7, sample_format="f32", nodata="-1")
    _saved(tiled(S.sales(spark, d), S.SALES, (5, 7)), "cog", path, S.SALES, "append", **options)
    _saved(tiled(S.holes(spark, d), S.SALES, (5, 7)), "cog", path, S.SALES, **options)
    return _cells(_read(spark, "cog", path))


@_query(f"SELECT 0 AS band, row, col, tax AS value FROM ({S.SQL_BANDS}) UNION ALL SELECT 1 AS band, row, col, discount AS value FROM ({S.SQL_BANDS})")
def write_format_geotiff(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "written.tif")
    _saved(tiled(G.banded(list(S.bands(spark, d))), S.SALES), "geotiff", path, S.SALES, bands=2, sample_format="u32")
    return _read(spark, "geotiff", path).select("band", "row", "col", "value")


@_query(f"SELECT 0 AS band, row, col, CASE WHEN (row * 7 + col * 3) % 11 <> 0 THEN tax END AS value FROM ({S.SQL_BANDS}) UNION ALL SELECT 1 AS band, row, col, discount AS value FROM ({S.SQL_BANDS})")
def cog_bands(spark: SparkSession, d: str) -> DataFrame:
    """Two bands of whole numbers, deflated, with a nodata value."""
    tax, discount = S.bands(spark, d)
    tax = tax.withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 != 0, F.col("value")))
    path = _file(spark, "bands.cog.tif")
    R.write_cog(G.banded([tax, discount]), path, S.SALES, 2, "i32", (5, 7), 1, True, -9999.0)
    return _read(spark, "cog", path).select("band", "row", "col", "value")


@_query(f"SELECT 2 AS predictor, row, col, value FROM ({S.SQL_PLANE}) UNION ALL SELECT 3, row, col, (value / 7)::FLOAT::DOUBLE FROM ({S.SQL_PLANE})")
def cog_predictors(spark: SparkSession, d: str) -> DataFrame:
    """Differences along rows: of whole numbers, and of the bytes of floating-point ones."""
    grid, out = S.plane_grid(spark, d), None
    for predictor, kind, cells in ((2, "u16", S.plane(spark, d)), (3, "f32", S.plane(spark, d).withColumn("value", F.col("value") / 7))):
        path = _file(spark, f"predicted{predictor}.cog.tif")
        R.write_cog(cells, path, grid, 1, kind, (TILE, TILE), 0, True, 65535.0 if predictor == 2 else float("nan"), predictor=predictor)
        part = _cells(_read(spark, "cog", path)).select(F.lit(predictor).alias("predictor"), "row", "col", "value")
        out = part if out is None else out.union(part)
    return out


@_query(f"SELECT row, col, CASE WHEN row >= {TILE} AND col >= {TILE} THEN value END AS value FROM ({S.SQL_PLANE})")
def cog_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Tiles without data have no bytes in the file and are read as no data."""
    cells = S.plane(spark, d).withColumn("value", F.when((F.col("row") >= TILE) & (F.col("col") >= TILE), F.col("value")))
    path = _file(spark, "sparse.cog.tif")
    R.write_cog(cells, path, S.plane_grid(spark, d), 1, "f32", (TILE, TILE), 1, True, -1.0, predictor=3, sparse=True)
    return _cells(_read(spark, "cog", path))


_SQL_MASKED = f"SELECT 0 AS band, row, col, CASE WHEN (row + col) % 5 <> 0 THEN value END AS value FROM ({S.SQL_PLANE}) UNION ALL SELECT 1, row, col, CASE WHEN (row + col) % 5 <> 0 THEN value + 1 END FROM ({S.SQL_PLANE})"


@_query(_SQL_MASKED)
def cog_masked(spark: SparkSession, d: str) -> DataFrame:
    """Two bands of whole numbers whose missing cells are told by a mask alone; zeros are data."""
    one = S.plane(spark, d).withColumn("value", F.when((F.col("row") + F.col("col")) % 5 != 0, F.col("value")))
    path = _file(spark, "masked.cog.tif")
    R.write_cog(G.banded([one, one.withColumn("value", F.col("value") + 1)]), path, S.plane_grid(spark, d), 2, "u16", (TILE, TILE), 1, True, masked=True, predictor=2)
    return _read(spark, "cog", path).select("band", "row", "col", "value")


@_query(f"SELECT row, col, floor(value * 1e6 + 0.5) / 1e6 AS value FROM ({_SQL_HALF.format(_SQL_HALF.format(_SQL_HALF.format(_SQL_HALF.format(S.SQL_PLANE))))})")
def cog_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A file written without options has tiles of 256 and four overviews; the last of them."""
    path = _file(spark, "defaults.cog.tif")
    R.write_cog(S.plane(spark, d), path, S.plane_grid(spark, d))
    return _cells(_read(spark, "cog", path, level=4)).withColumn("value", F.floor(F.col("value") * 1e6 + 0.5) / 1e6)


@_query(f"SELECT 'east.tif' AS raster_id, row, col, CASE WHEN col >= 8 THEN value END AS value FROM ({S.SQL_SALES}) UNION ALL SELECT 'west.tif', row, col, CASE WHEN col < 8 THEN value END FROM ({S.SQL_SALES})")
def stream_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive in a folder, the second one while the stream runs; their cells by readStream."""
    folder, sink = _file(spark, "arriving"), _file(spark, "arrived")
    os.makedirs(folder)
    R.register(spark)

    def arrive(name: str, here) -> None:
        R.write_geotiff(S.sales(spark, d).withColumn("value", F.when(here, F.col("value"))), f"{folder}/{name}", S.SALES)

    arrive("west.tif", F.col("col") < 8)
    cells = spark.readStream.format("geotiff").option("path", folder).load()
    query = cells.writeStream.format("parquet").option("path", sink).option("checkpointLocation", _file(spark, "arriving-log")).start()
    try:
        query.processAllAvailable()
        arrive("east.tif", F.col("col") >= 8)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(sink).select("raster_id", "row", "col", "value")


@_query("WITH s AS (SELECT floor(sqrt(count(*)))::INT AS n FROM lineitem), l(level) AS (VALUES (0), (1), (2)) SELECT level::INT AS level, ceil(n / 2 ** level)::INT AS width, ceil(n / 2 ** level)::INT AS height, (2 ** level)::DOUBLE AS pixel_width, 4326::INT AS epsg, 1::INT AS bands, 'f64' AS sample_format, 48::INT AS tile_width, 8::INT AS compression, false AS masked FROM s, l")
def cog_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = _read(spark, "cog", _plane_cog(spark, d, deflate=True), metadata="true")
    return found.select("level", "width", "height", "pixel_width", "epsg", "bands", "sample_format", "tile_width", "compression", "masked")


@_query("SELECT r::INT AS row, c::INT AS col, ((r // 16) * 100 + c // 16 + 1000)::DOUBLE AS value FROM generate_series(0, 19) AS a(r), generate_series(0, 24) AS b(c)")
def cog_streamed_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles from a callback, one held at a time; read at the first overview."""
    path = _file(spark, "streamed.cog.tif")
    R.write_cog_tiles(path, G.Grid(50, 40), 1, "f32", (16, 16), 1, True, None, lambda level, c, r: np.full(256, level * 1000 + r * 100 + c, "<f4").tobytes())
    return _cells(_read(spark, "cog", path, level=1))


# -- GRIB and NetCDF: small files made here, read by the sources --


def _section(number: int, body: bytes) -> bytes:
    return struct.pack(">IB", 5 + len(body), number) + body


def grib_message(values: np.ndarray, reference: float = 0.0, binary: int = 0, decimal: int = 0, bits: int = 32) -> bytes:
    """An edition 2 message in simple packing of so many bits over a grid of 0.5 degrees."""
    packed = np.packbits((values.astype(np.int64).reshape(-1, 1) >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)).tobytes()
    nj, ni = values.shape
    when = struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, 2024, 1, 15, 12, 0, 0, 0, 1)
    place = bytearray(72)
    struct.pack_into(">II", place, 28, ni, nj)
    struct.pack_into(">ii", place, 44, 50_000_000, 10_000_000)
    struct.pack_into(">iiII", place, 53, 42_500_000, 17_500_000, 500_000, 500_000)
    product = bytearray(34 - 5)
    product[4:6] = bytes([2, 3])
    product[12] = 1
    struct.pack_into(">I", product, 13, 6)
    product[17] = 103
    struct.pack_into(">bi", product, 18, 0, 10)
    packing = struct.pack(">IHfhhBB", ni * nj, 0, reference, binary, decimal, bits, 0)
    body = _section(1, when[:16]) + _section(3, bytes(place)) + _section(4, bytes(product)) + _section(5, packing) + _section(6, b"\xff") + _section(7, packed) + b"7777"
    return b"GRIB\0\0\x00\x02" + struct.pack(">Q", 16 + len(body)) + body


def _matrix(cells: DataFrame, missing: float) -> np.ndarray:
    """A small grid on the driver."""
    out = np.full((16, 16), missing)
    for r in cells.collect():
        if r["value"] is not None:
            out[r["row"], r["col"]] = r["value"]
    return out


@_query(f"SELECT row, col, CASE WHEN value <> 9999 THEN value END AS value FROM ({S.SQL_HOLES})")
def read_grib(spark: SparkSession, d: str) -> DataFrame:
    """9999 stands for no data."""
    path = _file(spark, "a.grib2")
    FileWrite(path).create(grib_message(_matrix(S.holes(spark, d), 9999)))
    return _cells(_read(spark, "grib2", path))


@_query(f"SELECT row, col, (5 + value * 4) / 100.0 AS value FROM ({S.SQL_SALES}) WHERE row < 9")
def grib_scaled_message(spark: SparkSession, d: str) -> DataFrame:
    """The second of two messages with bytes of no message between them; values are (5 + 4 X) / 100."""
    path = _file(spark, "b.grib2")
    plain = _matrix(S.sales(spark, d), 0)
    FileWrite(path).create(grib_message(plain) + b"between" + grib_message(plain, 5.0, 2, 2))
    return _cells(_read(spark, "grib2", path, message=1).where(F.col("row") < 9))


@_query(f"SELECT message, row, col, (5 + CASE message WHEN 0 THEN value::INT % 2 WHEN 1 THEN value::INT % 4096 ELSE 0 END)::DOUBLE AS value FROM ({S.SQL_SALES}), (VALUES (0::INT), (1), (2)) AS m(message)")
def grib_bits(spark: SparkSession, d: str) -> DataFrame:
    """Messages of 1, 12 and 0 bits a value over a reference of 5."""
    path = _file(spark, "bits.grib2")
    plain = _matrix(S.sales(spark, d), 0)
    FileWrite(path).create(b"".join(grib_message(plain % (1 << bits), 5.0, bits=bits) for bits in (1, 12, 0)))
    return _read(spark, "grib2", path).select(F.col("band").alias("message"), "row", "col", "value")


@_query("SELECT k::INT AS message, 'simple' AS packing, 'lat_lon' AS template, 16::INT AS ni, 16::INT AS nj, 0.5::DOUBLE AS cell_size, '2024-01-15 12:00:00' AS reference_time, 2::INT AS category, 6::INT AS forecast_time, 'hour' AS time_unit, 10::DOUBLE AS level_value FROM generate_series(0, 1) AS g(k)")
def grib_messages(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "c.grib2")
    FileWrite(path).create(grib_message(np.ones((16, 16))) + grib_message(np.ones((16, 16)), 1.0))
    return _read(spark, "grib2", path, metadata="true").select("message", "packing", "template", "ni", "nj", "cell_size", "reference_time", "category", "forecast_time", "time_unit", "level_value")


def netcdf_file(values: np.ndarray, version: int, attributes: dict[str, float]) -> bytes:
    """A classic file of one double variable over (lat, lon), with coordinates in degrees."""
    name = lambda text: struct.pack(">I", len(text)) + text.encode().ljust(-(-len(text) // 4) * 4, b"\0")
    text = lambda key, value: name(key) + struct.pack(">II", 2, len(value)) + value.encode().ljust(-(-len(value) // 4) * 4, b"\0")
    height, width = values.shape
    own = struct.pack(">II", 12, len(attributes)) + b"".join(name(k) + struct.pack(">IId", 6, 1, v) for k, v in attributes.items())
    degrees = struct.pack(">II", 12, 1) + text("units", "degrees_east")
    place = ">Q" if version == 2 else ">I"

    def head(at: int) -> bytes:
        out = b"CDF" + bytes([version]) + struct.pack(">III", 0, 10, 2) + name("lat") + struct.pack(">I", height) + name("lon") + struct.pack(">I", width)
        out += struct.pack(">II", 12, 1) + text("title", "sales") + struct.pack(">II", 11, 2)
        out += name("lon") + struct.pack(">II", 1, 1) + degrees + struct.pack(">II", 6, 8 * width) + struct.pack(place, at)
        return out + name("sold") + struct.pack(">III", 2, 0, 1) + own + struct.pack(">II", 6, 8 * width * height) + struct.pack(place, at + 8 * width)

    return head(len(head(0))) + np.arange(width, dtype=">f8").tobytes() + values.astype(">f8").tobytes()


@_query(f"SELECT row, col, value FROM ({S.SQL_HOLES})")
def read_netcdf(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "a.nc")
    FileWrite(path).create(netcdf_file(_matrix(S.holes(spark, d), -1.0), 1, {"_FillValue": -1.0}))
    return _cells(_read(spark, "netcdf", path, variable="sold"))


@_query(f"SELECT row, col, value * 0.5 + 3 AS value FROM ({S.SQL_SALES}) WHERE row BETWEEN 4 AND 11")
def netcdf_scaled_window(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "b.nc")
    FileWrite(path).create(netcdf_file(_matrix(S.sales(spark, d), 0.0), 2, {"scale_factor": 0.5, "add_offset": 3.0}))
    return _cells(_read(spark, "netcdf", path, variable="sold", row_min=4, row_max=11))


@_query("SELECT 'lon' AS variable, 'double' AS data_type, 1::INT AS n_dimensions, 22.5::DOUBLE AS cell_size, NULL AS fill, 'sales' AS title UNION ALL SELECT 'sold', 'double', 2, 22.5, '-1.0', 'sales'")
def netcdf_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "c.nc")
    FileWrite(path).create(netcdf_file(np.ones((16, 16)), 1, {"_FillValue": -1.0}))
    found = _read(spark, "netcdf", path, metadata="true")
    return found.select("variable", "data_type", F.size("dimensions").alias("n_dimensions"), "cell_size", F.col("attributes")["_FillValue"].alias("fill"), F.col("global_attributes")["title"].alias("title"))
