"""Raster files as targets of df.write: parts under temporary names, put together or named on commit.

Cells come as (row, col, value) with band and level where there are several; tiled() deals
them so that each tile is whole in one task. A tile of uncompressed samples has a known place,
and its task writes it there, into a temporary object; deflated tiles go to a part of their
task, and the parts are joined when their sizes are known. The target's name is taken by a
rename on commit, so a failed job leaves neither a part nor half a file.
"""

from __future__ import annotations

import importlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from gridweft.functions.grid import Grid, InvalidInput
from gridweft.operators.pyramid import generate_overviews
from gridweft.sources import tiff
from gridweft.sources.samples import check_nodata, format_named, local_path

GEOTIFF_ROWS = 256


class ObjectWrite:
    """Where a job's temporary objects and its target are; stores other than folders subclass it."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def exists(self) -> bool:
        raise NotImplementedError

    def begin(self) -> None:
        """An empty temporary object and room for parts; tasks that outlive discard() must not bring either back."""
        raise NotImplementedError

    def place(self, offset: int, body: bytes) -> None:
        """Bytes of the temporary object; a task that runs again writes the same ones."""
        raise NotImplementedError

    def part(self, name: str):
        """A new part as a writable file object; its name is another for each attempt of a task."""
        raise NotImplementedError

    def join(self, at: int, pieces: list[tuple[str, int, int]]) -> None:
        """Appends pieces (part, offset, length) to the temporary object from place `at` on."""
        raise NotImplementedError

    def finish(self) -> None:
        """The temporary object takes the target's name; parts go."""
        raise NotImplementedError

    def discard(self) -> None:
        """Nothing of the job stays."""
        raise NotImplementedError


class FileObject(ObjectWrite):
    """A file in a folder that driver and executors share, renamed in one step."""

    _AT_ONCE = 64 << 20

    def __init__(self, path: str, job: str):
        super().__init__(local_path(path), job)
        self.temporary, self.parts = f"{self.path}.{job}.tmp", f"{self.path}.{job}.parts"

    def exists(self) -> bool:
        return os.path.exists(self.path)

    def begin(self) -> None:
        os.makedirs(self.parts)
        open(self.temporary, "wb").close()

    def place(self, offset: int, body: bytes) -> None:
        fd = os.open(self.temporary, os.O_WRONLY)
        try:
            view = memoryview(body)
            while len(view):
                n = os.pwrite(fd, view, offset)
                view, offset = view[n:], offset + n
        finally:
            os.close(fd)

    def part(self, name: str):
        return open(f"{self.parts}/{name}", "wb")

    def join(self, at: int, pieces: list[tuple[str, int, int]]) -> None:
        """By the kernel's copy, which moves bytes between files without this process."""
        with open(self.temporary, "r+b") as out:
            for name, offset, length in pieces:
                with open(f"{self.parts}/{name}", "rb") as part:
                    while length:
                        n = os.copy_file_range(part.fileno(), out.fileno(), min(length, self._AT_ONCE), offset, at)
                        if not n:
                            raise InvalidInput(f"part {name} is shorter than its task said")
                        offset, at, length = offset + n, at + n, length - n

    def finish(self) -> None:
        os.replace(self.temporary, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def discard(self) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its part, and (level, tile, offset, length) of each tile in it."""

    part: str
    tiles: list[tuple[int, int, int, int]]


def _grid(options) -> Grid:
    """The grid of the options width, height and, where they are given, cell_size, origin_x and so on."""
    given = {f.name: options[f.name] for f in fields(Grid) if f.name in options}
    if "width" not in given or "height" not in given:
        raise InvalidInput("a raster file needs the options width and height")
    return Grid(**{k: int(v) if k in ("width", "height", "epsg") else float(v) for k, v in given.items()})


class TileWriter(DataSourceArrowWriter):
    """Tiles of a pyramid, or the row blocks of a one-strip file, from cells that tiled() has dealt."""

    def __init__(self, options, overwrite: bool, strips: bool):
        if "path" not in options:
            raise InvalidInput("a raster file needs a path")
        self.grid, self.strips, self.job = _grid(options), strips, uuid.uuid4().hex
        self.bands = int(options.get("bands", 1))
        self.format = format_named(options.get("sample_format", "f64"))
        self.deflate = options.get("deflate", "false") == "true" and not strips
        text = options.get("nodata", "-9999" if strips else "nan")
        self.nodata = None if text == "none" else float(text)
        if not strips:
            check_nodata(self.format, self.nodata)
        self.overviews = 0 if strips else int(options.get("overviews", 0))
        self.tile = (self.grid.width, GEOTIFF_ROWS) if strips else (int(options.get("tile_width", 256)), int(options.get("tile_height", 256)))
        self.sizes = tiff.level_sizes(self.grid, self.overviews)
        self.path, self.transport = options["path"], options.get("transport")
        if not overwrite and self._object().exists():
            raise InvalidInput(f"{self.path} exists; mode overwrite replaces it")
        self._object().begin()

    def _object(self) -> ObjectWrite:
        if not self.transport:
            return FileObject(self.path, self.job)
        module, _, name = self.transport.partition(":")
        return getattr(importlib.import_module(module), name)(self.path, self.job)

    def _across(self, level: int) -> int:
        return -(-self.sizes[level][0] // self.tile[0])

    def _tiles(self) -> list[int]:
        """How many tiles each level has."""
        return [self._across(k) * -(-h // self.tile[1]) for k, (_, h) in enumerate(self.sizes)]

    def _rows(self, tile: int) -> int:
        """Rows of a tile that are in the file: all of a tile's, and of a strip's last block those of the image."""
        return min(self.tile[1], self.grid.height - tile * self.tile[1]) if self.strips else self.tile[1]

    def _encoded(self, level: int, tile: int, values: np.ndarray) -> bytes:
        width, height = self.sizes[level]
        values = values[: self._rows(tile)]
        row, col = tile // self._across(level) * self.tile[1], tile % self._across(level) * self.tile[0]
        if self.format.integer_range and self.nodata is None and np.isnan(values[: height - row, : width - col]).any():
            raise InvalidInput(f"cells without data in {self.format.name} need a nodata value")
        if self.nodata is not None:
            values = np.where(np.isnan(values), self.nodata, values)
        body = self.format.encode(values.reshape(-1))
        return zlib.compress(body) if self.deflate else body

    def _header(self, counts: list[list[int]]) -> bytes:
        if self.strips:
            return tiff.geotiff_header(self.grid, self.bands, self.format)
        return tiff.cog_header(self.grid, self.sizes, self.bands, self.format, self.tile, self.deflate, self.nodata, counts)

    def _places(self, counts: list[list[int]]) -> list[list[int]]:
        """Where each tile begins: after the header, coarsest level first."""
        at, out = len(self._header(counts)), [[0] * len(c) for c in counts]
        for level in range(len(counts) - 1, -1, -1):
            for tile, n in enumerate(counts[level]):
                out[level][tile], at = at, at + n
        return out

    def _plain_counts(self) -> list[list[int]]:
        return [[self._rows(t) * self.tile[0] * self.bands * self.format.bytes for t in range(n)] for n in self._tiles()]

    def _arrays(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, tile, values) of each run of cells of one tile; no tile may come twice."""
        done: set[tuple[int, int]] = set()
        current, values, raster = None, None, None
        limits = np.array(self.sizes)
        for batch in batches:
            if not batch.num_rows:
                continue
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            row, col = (np.asarray(named[c]).astype(np.int64) for c in ("row", "col"))
            level, band = (np.asarray(named[c]).astype(np.int64) if c in named else np.zeros(len(row), np.int64) for c in ("level", "band"))
            ids = named["raster_id"].unique().to_pylist() if "raster_id" in named else []
            raster = raster or (ids and ids[0])
            if any(i != raster for i in ids):
                raise InvalidInput("cells of several rasters in one file")
            if (level < 0).any() or (level >= len(limits)).any() or (row < 0).any() or (col < 0).any() or (col >= limits[level, 0]).any() or (row >= limits[level, 1]).any() or (band < 0).any() or (band >= self.bands).any():
                raise InvalidInput("cells outside the grid, its bands or its levels")
            across = np.array([self._across(k) for k in range(len(limits))])
            tile = row // self.tile[1] * across[level] + col // self.tile[0]
            value = named["value"].cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(level) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
                here = (int(level[a]), int(tile[a]))
                if here != current:
                    if current is not None:
                        yield *current, values
                    if here in done:
                        raise InvalidInput(f"tile {here[1]} of level {here[0]} comes in pieces; deal cells by tiled()")
                    done.add(here)
                    current, values = here, np.full((self.tile[1], self.tile[0], self.bands), np.nan)
                values[row[a:b] % self.tile[1], col[a:b] % self.tile[0], band[a:b]] = value[a:b]
        if current is not None:
            yield *current, values

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target, name, tiles, at = self._object(), uuid.uuid4().hex, [], 0
        places = None if self.deflate else self._places(self._plain_counts())
        part = None
        try:
            for level, tile, values in self._arrays(iterator):
                body = self._encoded(level, tile, values)
                if places is not None:
                    target.place(places[level][tile], body)
                else:
                    part = part or target.part(name)
                    part.write(body)
                tiles.append((level, tile, at, len(body)))
                at += len(body)
        finally:
            if part:
                part.close()
        return Written(name, tiles)

    def commit(self, messages: list) -> None:
        """The header goes in, parts are joined, and the target takes its name; tiles without cells hold nodata."""
        target, found = self._object(), {}
        for message in filter(None, messages):
            for level, tile, offset, length in message.tiles:
                if (level, tile) in found:
                    raise InvalidInput(f"cells of tile {tile} of level {level} came from several tasks; deal them by tiled()")
                found[level, tile] = (message.part, offset, length)
        counts = [[0] * n for n in self._tiles()]
        absent = [(k, t) for k, c in enumerate(counts) for t in range(len(c)) if (k, t) not in found]
        if any(k > 0 for k, _ in absent):
            raise InvalidInput("a level without all its cells; overviews come from tiled()")
        empty = {}
        for level, tile in absent:
            rows = self._rows(tile)
            if rows not in empty:
                empty[rows] = self._encoded(level, tile, np.full((self.tile[1], self.tile[0], self.bands), np.nan))
        for level, tile in found:
            counts[level][tile] = found[level, tile][2]
        for level, tile in absent:
            counts[level][tile] = len(empty[self._rows(tile)])
        target.place(0, self._header(counts))
        places = self._places(counts)
        for level, tile in absent:
            target.place(places[level][tile], empty[self._rows(tile)])
        if self.deflate:
            for (level, tile), piece in sorted(found.items(), key=lambda f: places[f[0][0]][f[0][1]]):
                target.join(places[level][tile], [piece])
        target.finish()

    def abort(self, messages: list) -> None:
        self._object().discard()


def tiled(cells: DataFrame, grid: Grid, tile: tuple[int, int] | None = None, overviews: int = 0) -> DataFrame:
    """(level, band, row, col, value) as df.write.format("cog") takes it, for the same tile size and overviews; with no tile as "geotiff" does.

    Each tile of each level is whole in one task, and a task's tiles come one after another.
    Only tiles are shuffled by, so a large grid goes to as many tasks as it has tiles.
    """
    tw, th = tile or (max(1, grid.width), GEOTIFF_ROWS)
    banded = cells if "band" in cells.columns else cells.withColumn("band", F.lit(0))
    key = banded.select(F.col("band").cast("string").alias("raster_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    every = None
    for k, level in enumerate([key, *generate_overviews(key, overviews)]):
        part = level.withColumn("level", F.lit(k))
        every = part if every is None else every.unionByName(part)
    y, x = F.floor(F.col("row") / th), F.floor(F.col("col") / tw)
    dealt = every.repartition("level", y, x).sortWithinPartitions("level", y, x)
    return dealt.select("level", F.col("raster_id").cast("int").alias("band"), "row", "col", "value")
