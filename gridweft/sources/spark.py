"""Raster files as Spark data sources, and grids written to raster files.

register(spark) adds the formats geotiff, cog, grib2 and netcdf. A reader plans from headers
alone; executors fetch the strips, tiles, messages or rows of their partitions.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridweft.functions.grid import Grid, InvalidInput
from gridweft.functions.rounds import cut
from gridweft.operators.pyramid import generate_overviews, select_level
from gridweft.ship import ship
from gridweft.sources import grib, netcdf, tiff
from gridweft.sources.samples import FileRange, FileWrite, RangeRead, RangeWrite, check_nodata, format_named, local_path
from gridweft.sources.sinks import TileWriter

CELLS = "raster_id string, band int, row int, col int, value double"


@dataclass
class Part(InputPartition):
    """A piece of a file with all that its task has to know of it, so that no task reads headers again."""

    what: object

    def __init__(self, what: object):
        super().__init__(what)
        self.what = what


def open_range(options: dict) -> RangeRead:
    """The file at `path`, or what the class named by `transport` (module:Class) makes of it."""
    if "path" not in options:
        raise InvalidInput("a raster source needs a path")
    if transport := options.get("transport"):
        module, _, name = transport.partition(":")
        return getattr(importlib.import_module(module), name)(options["path"])
    return FileRange(options["path"])


def _batch(raster_id: str, row: int, col: int, values: np.ndarray, bands: list[int] | None = None) -> pa.RecordBatch:
    """Cells of (rows, columns, bands) values whose corner lies at (row, col)."""
    rows, cols, n = values.shape
    r, c, b = np.meshgrid(np.arange(row, row + rows, dtype=np.int32), np.arange(col, col + cols, dtype=np.int32), np.array(bands if bands is not None else range(n), np.int32), indexing="ij")
    flat = values.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array([raster_id] * len(flat), pa.string()), pa.array(b.reshape(-1)), pa.array(r.reshape(-1)), pa.array(c.reshape(-1)), pa.array(flat, pa.float64(), mask=np.isnan(flat))], ["raster_id", "band", "row", "col", "value"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.raster_id = self.options.get("raster_id", os.path.basename(self.options.get("path", "")))

    def _box(self, grid: Grid) -> tuple[int, int, int, int]:
        """(col0, row0, col1, row1) of the options row_min, row_max, col_min and col_max."""
        o = self.options
        return max(0, int(o.get("col_min", 0))), max(0, int(o.get("row_min", 0))), min(grid.width - 1, int(o.get("col_max", grid.width - 1))), min(grid.height - 1, int(o.get("row_max", grid.height - 1)))

    def _emit(self, row: int, col: int, values: np.ndarray, grid: Grid) -> pa.RecordBatch:
        c0, r0, c1, r1 = self._box(grid)
        values = values[max(0, r0 - row) : max(0, r1 - row + 1), max(0, c0 - col) : max(0, c1 - col + 1)]
        bands = [b for b in range(values.shape[2]) if int(self.options.get("band", b)) == b]
        return _batch(self.raster_id, max(row, r0), max(col, c0), values[:, :, bands], bands)


    def describe(self) -> list[dict]:
        """Rows of the metadata table."""
        raise NotImplementedError


class GeoTiffReader(_Reader):
    _ROWS = 256

    def partitions(self) -> list[Part]:
        d = tiff.directories(open_range(self.options))[0]
        slim = tiff.Directory({t: v for t, v in d.tags.items() if t not in (tiff.STRIP_OFFSETS, tiff.STRIP_COUNTS)}, 0)
        _, r0, _, r1 = self._box(tiff.geometry(d))
        parts = []
        for s in tiff.strips(d):
            row_bytes = s.length // max(1, s.rows)
            for k in range(0, s.rows, self._ROWS):  # a strip may be the whole image
                rows = min(self._ROWS, s.rows - k)
                if s.row + k <= r1 and s.row + k + rows > r0:
                    parts.append(Part((slim, tiff.Strip(s.row + k, rows, s.offset + k * row_bytes, rows * row_bytes))))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        d, strip = partition.what
        yield self._emit(strip.row, 0, tiff.read_strip(open_range(self.options), d, strip), tiff.geometry(d))

    def describe(self) -> list[dict]:
        d = tiff.directories(open_range(self.options))[0]
        return [_shape(0, tiff.geometry(d), d.one(tiff.SAMPLES, 1), tiff.sample_format(d).name) | {"tile_width": d.need(tiff.WIDTH)[0], "tile_height": d.one(tiff.ROWS_PER_STRIP, d.need(tiff.LENGTH)[0])}]


def _shape(level: int, grid: Grid, bands: int, sample_format: str) -> dict:
    return {"level": level, "width": grid.width, "height": grid.height, "pixel_width": grid.pixel_width, "pixel_height": grid.pixel_height, "origin_x": grid.origin_x, "origin_y": grid.origin_y, "epsg": grid.epsg, "bands": bands, "sample_format": sample_format}


class CogReader(_Reader):
    _TILE_BYTES = 8 << 20

    def _level(self, source: RangeRead) -> tiff.Level:
        levels = tiff.open_levels(source)
        if "resolution" in self.options:
            return levels[select_level([x.grid.pixel_width for x in levels], float(self.options["resolution"]))]
        return levels[int(self.options.get("level", 0))]

    def partitions(self) -> list[Part]:
        """Neighbouring tiles of about 8 MB of pixels (option tile_bytes), with the places of their bytes."""
        level = self._level(open_range(self.options))
        c0, r0, c1, r1 = self._box(level.grid)
        tiles = tiff.touched(level, c0, r0, c1 - c0 + 1, r1 - r0 + 1)
        spans = [(t, level.span(t), level.mask.span(t) if level.mask else (0, 0)) for t in tiles]
        step = max(1, int(self.options.get("tile_bytes", self._TILE_BYTES)) // (8 * level.tile[0] * level.tile[1] * level.bands))
        slim = level.without_spans()
        return [Part((slim, spans[k : k + step])) for k in range(0, len(spans), step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        level, spans = partition.what
        source = open_range(self.options)
        wanted = [s for _, span, mask in spans for s in (span, mask) if s[1]]
        bodies = dict(zip(wanted, source.read_ranges(wanted), strict=True))  # neighbouring tiles, so few requests
        for tile, span, mask in spans:
            yield self._emit(*tiff.tile_of(level, tile, bodies.get(span, b""), bodies.get(mask, b"")), level.grid)

    def describe(self) -> list[dict]:
        levels = tiff.open_levels(open_range(self.options))
        return [_shape(k, x.grid, x.bands, x.format.name) | {"tile_width": x.tile[0], "tile_height": x.tile[1], "compression": x.compression, "predictor": x.predictor, "nodata": x.nodata, "masked": x.mask is not None} for k, x in enumerate(levels)]


class GribReader(_Reader):
    def _messages(self) -> list[dict]:
        source = open_range(self.options)
        return grib.scan(source, int(self.options.get("size", 0)) or source.size())

    def partitions(self) -> list[Part]:
        wanted = self.options.get("message")
        return [Part((k, m)) for k, m in enumerate(self._messages()) if wanted is None or k == int(wanted)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        number, message = partition.what
        values = grib.decode(open_range(self.options), message)
        c0, r0, c1, r1 = self._box(grib.geometry(message))
        yield _batch(self.raster_id, r0, c0, values[r0 : r1 + 1, c0 : c1 + 1, None], [number])

    def describe(self) -> list[dict]:
        out = []
        for k, m in enumerate(self._messages()):
            t, g, p = m["reference_time"] or {}, m["grid"], m["product"] or {}
            when = "{year:04d}-{month:02d}-{day:02d} {hour:02d}:{minute:02d}:{second:02d}".format(**t) if t else None
            out.append({"message": k, "discipline": m["discipline"], "reference_time": when, "packing": m["packing"], "cell_size": g["di"]} | {c: g[c] for c in ("template", "ni", "nj", "lat_first", "lon_first", "lat_last", "lon_last", "di", "dj", "scan_mode")} | {c: p.get(c) for c in ("category", "number", "forecast_time", "time_unit", "level_type", "level_value")})
        return out


class NetCdfReader(_Reader):
    _ROWS = 512

    def partitions(self) -> list[Part]:
        v = netcdf.find(netcdf.metadata(open_range(self.options)), self.options.get("variable", ""))
        height, width = v["shape"][-2:]
        _, r0, _, r1 = self._box(Grid(width, height))
        return [Part((v, k)) for k in range(0, height, self._ROWS) if k <= r1 and k + self._ROWS > r0]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        v, row = partition.what
        height, width = v["shape"][-2:]
        rows = min(self._ROWS, height - row)
        yield self._emit(row, 0, netcdf.read_rows(open_range(self.options), v, row, rows)[:, :, None], Grid(width, height))

    def describe(self) -> list[dict]:
        meta = netcdf.metadata(open_range(self.options))
        texts = lambda own: {k: a["text"] if a["text"] is not None else " ".join(map(repr, a["nums"])) for k, a in own.items()}
        return [{"variable": v["name"], "data_type": v["data_type"], "dimensions": v["dimensions"], "shape": v["shape"], "cell_size": netcdf.cell_size(meta, v) if v["dimensions"] else None, "attributes": texts(v["attributes"]), "global_attributes": texts(meta["global_attributes"])} for v in meta["variables"]]


class _MetadataReader(DataSourceReader):
    """The one-partition table of the option metadata=true: levels, messages or variables of a file."""

    def __init__(self, reader: _Reader, fields: list[str]):
        self.inner, self.fields = reader, fields

    def partitions(self) -> list[Part]:
        return [Part(0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for row in self.inner.describe():
            yield tuple(row.get(f) for f in self.fields)


def _guarded(reader: type[_Reader]) -> type[_Reader]:
    """The reader with one empty partition where it has none, for Spark has a task read that all the same."""

    class Guarded(reader):
        nothing = False

        def partitions(self):
            return ([] if self.nothing else super().partitions()) or [Part(None)]

        def read(self, partition):
            return iter(()) if partition.what is None else super().read(partition)

    return Guarded


def _filters_may_come() -> bool:
    """Whether this process plans a read with filters. Where a session keeps filters from Python sources, a reader that takes them is an error."""
    main = getattr(sys.modules.get("__main__"), "__spec__", None)
    return any(name.endswith("data_source_pushdown_filters") for name in (*sys.modules, main.name if main else ""))


def _pushing(reader: type[_Reader]) -> type[_Reader]:
    """The reader with comparisons of raster_id, band, row and col by literals turned into its options.

    register() lets filters reach Python sources in its session; push=false leaves them to
    Spark, push=true makes it an error if the session keeps them back. All filters are applied again by Spark, so what is read may be more than what they keep.
    """

    class Pushing(_guarded(reader)):
        def pushFilters(self, filters):
            for f in filters:
                name, column, value = type(f).__name__, ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
                if column == "band" and name == "EqualTo":
                    if "band" in self.options and self.options["band"] != str(value):
                        self.nothing = True
                    self.options["band"] = str(value)
                elif column == "raster_id" and name in ("EqualTo", "In"):
                    self.nothing |= self.raster_id not in (value if name == "In" else (value,))
                elif column in ("row", "col") and isinstance(value, int):
                    low = {"EqualTo": value, "GreaterThanOrEqual": value, "GreaterThan": value + 1}.get(name)
                    high = {"EqualTo": value, "LessThanOrEqual": value, "LessThan": value - 1}.get(name)
                    if low is not None:
                        self.options[f"{column}_min"] = str(max(low, int(self.options.get(f"{column}_min", 0))))
                    if high is not None:
                        self.options[f"{column}_max"] = str(min(high, int(self.options.get(f"{column}_max", high))))
                yield f

    return Pushing


class _FilesReader(DataSourceStreamReader):
    """The cells of raster files of one folder as they arrive; an offset is the last file's time and name.

    Files count once they have their name, so writers should rename into the folder, as this
    package's do. A batch plans from the headers of its own files only.
    """

    def __init__(self, reader: type[_Reader], options: dict):
        self.reader, self.options = reader, dict(options)
        self.folder, self.most = local_path(self.options["path"]), int(self.options.get("max_files", 1000))
        self.last = {"time": 0, "name": ""}

    def _files(self) -> list[tuple[int, str]]:
        return sorted((entry.stat().st_mtime_ns, entry.name) for entry in os.scandir(self.folder) if entry.is_file() and not entry.name.endswith(".tmp"))

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        later = [f for f in self._files() if f > (self.last["time"], self.last["name"])][: self.most]
        if later:
            self.last = {"time": later[-1][0], "name": later[-1][1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = max(self.last, end, key=lambda o: (o["time"], o["name"]))
        named = [name for time, name in self._files() if (start["time"], start["name"]) < (time, name) <= (end["time"], end["name"])]
        out = []
        for name in named:
            options = self.options | {"path": f"{self.folder}/{name}", "raster_id": name}
            out += [Part((options, part)) for part in self.reader(options).partitions()]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        options, part = partition.what
        return self.reader(options).read(part)

    def commit(self, end: dict) -> None:
        pass


#: Columns of the metadata tables.
_IMAGES = "level int, width int, height int, pixel_width double, pixel_height double, origin_x double, origin_y double, epsg int, bands int, sample_format string, tile_width int, tile_height int, compression int, predictor int, nodata double, masked boolean"
_MESSAGES = "message int, discipline int, reference_time string, packing string, template string, ni int, nj int, lat_first double, lon_first double, lat_last double, lon_last double, di double, dj double, scan_mode int, category int, number int, forecast_time int, time_unit string, level_type int, level_value double, cell_size double"
_VARIABLES = "variable string, data_type string, dimensions array<string>, shape array<int>, cell_size double, attributes map<string,string>, global_attributes map<string,string>"


class _Source(DataSource):
    reader_class: type[_Reader]

    metadata = _IMAGES

    def _described(self) -> bool:
        return self.options.get("metadata") == "true"

    def schema(self) -> str:
        return self.metadata if self._described() else CELLS

    def reader(self, schema) -> DataSourceReader:
        if self._described():
            return _MetadataReader(self.reader_class(self.options), [f.name for f in schema.fields])
        push = self.options.get("push", str(_filters_may_come()).lower())
        return (_pushing if push == "true" else _guarded)(self.reader_class)(self.options)


    def streamReader(self, schema) -> DataSourceStreamReader:
        """Cells of the files that arrive in the folder `path`, raster_id being the file's name."""
        return _FilesReader(self.reader_class, self.options)


class GeoTiffSource(_Source):
    reader_class = GeoTiffReader

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, overwrite, strips=True)


class CogSource(_Source):
    reader_class = CogReader

    @classmethod
    def name(cls) -> str:
        return "cog"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, overwrite, strips=False)


class GribSource(_Source):
    reader_class = GribReader
    metadata = _MESSAGES

    @classmethod
    def name(cls) -> str:
        return "grib2"


class NetCdfSource(_Source):
    reader_class = NetCdfReader
    metadata = _VARIABLES

    @classmethod
    def name(cls) -> str:
        return "netcdf"


def register(spark: SparkSession) -> None:
    """Adds the formats to the session and lets filters reach their readers."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GeoTiffSource, CogSource, GribSource, NetCdfSource):
        spark.dataSource.register(source)


# -- sinks --


def _bands(cells: DataFrame) -> DataFrame:
    return cells if "band" in cells.columns else cells.withColumn("band", F.lit(0))


def open_sink(path: str, transport: str | None = None) -> RangeWrite:
    """The file at `path`, or what the class named by `transport` (module:Class) makes of it; executors and driver see one file."""
    if transport:
        module, _, name = transport.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    return FileWrite(path)


def _placed(pieces: DataFrame, path: str, transport: str | None, header: bytes, size: int) -> None:
    """A file of the header and (at, body) pieces, `size` bytes of them, each put in its place by the task that holds it.

    Where the store can rename, the file has another name until all its bytes are there.
    """
    target = f"{path}.{uuid.uuid4().hex}.tmp" if open_sink(path, transport).renames else path
    try:
        open_sink(target, transport).create(header)
        found = _put(pieces, target, transport)
        if found != size:
            raise InvalidInput(f"{found} bytes of {size} were written")
        if target != path:
            open_sink(target, transport).rename(path)
    except BaseException:
        if target != path:
            open_sink(target, transport).remove()
        raise


def _put(pieces: DataFrame, path: str, transport: str | None) -> int:
    """Writes pieces to their places; how many bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = open_sink(path, transport), 0
        for batch in batches:
            for at, body in zip(batch["at"].to_pylist(), batch["body"], strict=True):
                sink.write_range(at, body.as_buffer())
                n += len(body.as_buffer())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return pieces.select("at", "body").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _one_raster(cells: DataFrame) -> DataFrame:
    """cells, after a check that they are of one raster: a file holds no other."""
    if "raster_id" in cells.columns and cells.select("raster_id").distinct().limit(2).count() > 1:
        raise InvalidInput("cells of several rasters in one file")
    return cells


def write_geotiff(cells: DataFrame, path: str, grid: Grid, bands: int = 1, sample_format: str = "f64", nodata: float = -9999.0, plain: bool = False, rows_a_block: int = 256, transport: str | None = None) -> None:
    """One file of one strip. The driver writes the header; blocks of rows are encoded and put in
    their places by the executors, which must see the same file (a shared folder, or a transport).

    plain=True gives the single-band f64 file of fixed byte layout. Cells that are absent or
    NULL hold nodata.
    """
    fmt = format_named(sample_format)
    header = tiff.geotiff_header(grid, bands, fmt, plain)
    block_bytes = rows_a_block * grid.width * bands * fmt.bytes

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        first = block * rows_a_block
        values = np.full((min(rows_a_block, grid.height - first), grid.width, bands), nodata)
        have = table.filter(pa.compute.is_valid(table["value"]))
        values[have["row"].to_numpy() - first, have["col"].to_numpy(), have["band"].to_numpy()] = have["value"].to_numpy()
        return pa.table({"at": pa.array([len(header) + block * block_bytes], pa.int64()), "body": pa.array([fmt.encode(values.reshape(-1))], pa.binary())})

    spark = cells.sparkSession
    ship(spark)
    cells = _bands(_one_raster(cells))
    rows = cells.select(F.floor(F.col("row") / rows_a_block).alias("block"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("band").cast("int").alias("band"), F.col("value").cast("double").alias("value"))
    every = spark.range(-(-grid.height // rows_a_block)).select(F.col("id").alias("block"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("band"), F.lit(None).cast("double").alias("value"))
    size = grid.height * grid.width * bands * fmt.bytes
    _placed(rows.union(every).groupBy("block").applyInArrow(encode, "at long, body binary"), path, transport, header, size)


def encoded_tiles(cells: DataFrame, grid: Grid, bands: int, sample_format: str, tile: tuple[int, int], overviews: int, deflate: bool, nodata: float | None, predictor: int = 1, sparse: bool = False, masked: bool = False) -> DataFrame:
    """(level, tile, body) of all levels of a pyramid, every tile padded and encoded.

    Of sparse files, tiles without data have no bytes. Of masked ones each tile has a mask of
    its pixels with data in all bands, as the tile of a level that follows those of images.
    """
    fmt, sizes = format_named(sample_format), tiff.level_sizes(grid, overviews)
    tw, th = tile
    by_band = _bands(cells).withColumn("raster_id", F.col("band").cast("string")).select("raster_id", "row", "col", "value")
    levels = [by_band, *generate_overviews(by_band, overviews)]
    every = None
    for k, level in enumerate(levels):
        part = level.withColumn("level", F.lit(k))
        every = part if every is None else every.unionByName(part)
    across = F.element_at(F.array(*[F.lit(-(-w // tw)) for w, _ in sizes]), F.col("level") + 1)
    placed = every.withColumn("tile", F.floor(F.col("row") / th) * across + F.floor(F.col("col") / tw))

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        values = np.full((th, tw, bands), np.nan)
        have = table.filter(pa.compute.is_valid(table["value"]))
        values[have["row"].to_numpy() % th, have["col"].to_numpy() % tw, [int(b) for b in have["raster_id"].to_pylist()]] = have["value"].to_numpy()
        width, height = sizes[key[0].as_py()]
        per_row = -(-width // tw)
        r, c = key[1].as_py() // per_row * th, key[1].as_py() % per_row * tw
        inside = values[: height - r, : width - c]
        if fmt.integer_range and nodata is None and not masked and np.isnan(inside).any():
            raise InvalidInput(f"cells without data in {fmt.name} need a nodata value")
        valid = ~np.isnan(values).any(axis=2)
        if masked:
            values = np.where(valid[:, :, None], values, 0.0)
        if sparse and nodata is not None and np.isnan(values).all():
            return pa.table({"level": key[:1], "tile": key[1:], "body": pa.array([b""], pa.binary())}, schema=pa.schema([("level", pa.int32()), ("tile", pa.int64()), ("body", pa.binary())]))
        if nodata is not None:
            values = np.where(np.isnan(values), nodata, values)
        bodies = [tiff.predicted(fmt.encode(values.reshape(-1)), predictor, fmt, tile, bands), *([tiff.packed_mask(valid)] if masked else [])]
        bodies = [zlib.compress(b) if deflate else b for b in bodies]
        of = [key[0].as_py() + k * len(sizes) for k in range(len(bodies))]
        return pa.table({"level": of, "tile": [key[1].as_py()] * len(of), "body": bodies}, schema=pa.schema([("level", pa.int32()), ("tile", pa.int64()), ("body", pa.binary())]))

    ship(cells.sparkSession)
    return placed.groupBy("level", "tile").applyInArrow(encode, "level int, tile long, body binary")


def write_cog(cells: DataFrame, path: str, grid: Grid, bands: int = 1, sample_format: str = "f64", tile: tuple[int, int] = (256, 256), overviews: int = 4, deflate: bool = False, nodata: float | None = float("nan"), transport: str | None = None, predictor: int = 1, sparse: bool = False, masked: bool = False) -> None:
    """A cloud-optimised GeoTIFF; cells must be dense.

    predictor 2 (whole numbers) or 3 (floating point) stores differences along rows, which
    deflate packs closer; sparse leaves out the bytes of tiles without data; masked tells cells
    without data by a mask of one bit a pixel, for all bands together, and takes no nodata.

    Tiles are encoded once and saved. The driver sees their sizes, numbers only, and writes the
    header; executors put the tiles in the places that follow from the sizes. All must see the
    same file (a shared folder, or a transport).
    """
    nodata = None if masked else nodata
    check_nodata(format_named(sample_format), nodata)
    tiff.check_predictor(format_named(sample_format), predictor)
    spark = cells.sparkSession
    tiles = cut(encoded_tiles(_one_raster(cells), grid, bands, sample_format, tile, overviews, deflate, nodata, predictor, sparse, masked))
    sizes = tiff.level_sizes(grid, overviews)
    counts = [[0] * (-(-w // tile[0]) * -(-h // tile[1])) for w, h in sizes * (2 if masked else 1)]
    for row in tiles.select("level", "tile", F.length("body").alias("n")).toLocalIterator():
        counts[row["level"]][row["tile"]] = row["n"]
    header = tiff.cog_header(grid, sizes, bands, format_named(sample_format), tile, deflate, nodata, counts, predictor)
    starts, at = [], len(header)
    for level in tiff.tile_order(len(counts), len(sizes)):
        for k, n in enumerate(counts[level]):
            starts.append((level, k, at))
            at += n
    places = spark.createDataFrame(starts, "level int, tile long, at long")
    _placed(tiles.join(places, ["level", "tile"]), path, transport, header, at - len(header))


def write_cog_tiles(path: str, grid: Grid, bands: int, sample_format: str, tile: tuple[int, int], overviews: int, deflate: bool, nodata: float | None, produce) -> None:
    """A cloud-optimised GeoTIFF of the bytes that produce(level, tile_col, tile_row) gives, coarsest level first.

    One tile is held at a time; the header is written last, over the room kept for it.
    """
    fmt, sizes = format_named(sample_format), tiff.level_sizes(grid, overviews)
    counts = [[0] * (-(-w // tile[0]) * -(-h // tile[1])) for w, h in sizes]
    room = len(tiff.cog_header(grid, sizes, bands, fmt, tile, deflate, nodata, counts))
    size = tile[0] * tile[1] * bands * fmt.bytes
    with open(path, "wb") as out:
        out.seek(room)
        for level in range(len(sizes) - 1, -1, -1):
            across = -(-sizes[level][0] // tile[0])
            for k in range(len(counts[level])):
                body = produce(level, k % across, k // across)
                if len(body) != size:
                    raise InvalidInput(f"a tile of {len(body)} bytes, not {size}")
                body = zlib.compress(body) if deflate else body
                counts[level][k] = len(body)
                out.write(body)
        out.seek(0)
        out.write(tiff.cog_header(grid, sizes, bands, fmt, tile, deflate, nodata, counts))
