"""GeoTIFF and cloud-optimised GeoTIFF: directories, strips and tiles as bytes and arrays."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np

from gridweft.functions.grid import FormatError, Grid, InvalidInput
from gridweft.sources.samples import RangeRead, SampleFormat, check_nodata, format_of, nodata_text, nodata_value

#: TIFF tags and the sizes of TIFF value types.
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 254, 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}
_NO_DATA = -9999.0


@dataclass
class Directory:
    """One image of a file, its values read."""

    tags: dict[int, tuple]
    next: int

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    def need(self, tag: int):
        if tag not in self.tags:
            raise FormatError(f"no tag {tag}")
        return self.tags[tag]


def directories(source: RangeRead) -> list[Directory]:
    """All image directories of a little-endian classic TIFF; no pixel is read."""
    head = source.read_range(0, 8)
    if head[:2] != b"II" or struct.unpack_from("<H", head, 2)[0] != 42:
        raise FormatError("not a little-endian classic TIFF")
    out, at = [], struct.unpack_from("<I", head, 4)[0]
    while at:
        (count,) = struct.unpack("<H", source.read_range(at, 2))
        body, tags = source.read_range(at + 2, count * 12 + 4), {}
        for k in range(count):
            tag, kind, n = struct.unpack_from("<HHI", body, 12 * k)
            if kind not in _TYPES:
                continue
            size = struct.calcsize("<" + _TYPES[kind]) * n
            raw = body[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else source.read_range(struct.unpack_from("<I", body, 12 * k + 8)[0], size)
            tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"<{n}{_TYPES[kind]}", raw)
        at = struct.unpack_from("<I", body, 12 * count)[0]
        out.append(Directory(tags, at))
        if len(out) > 1000:
            raise FormatError("image directories run in a circle")
    return out


def sample_format(d: Directory) -> SampleFormat:
    bits, kinds = set(d.tags.get(BITS, (1,))), set(d.tags.get(FORMAT, (1,)))
    if len(bits) > 1 or len(kinds) > 1:
        raise FormatError("bands of different formats")
    return format_of(bits.pop(), kinds.pop())


def geometry(d: Directory) -> Grid:
    """Shape and place of an image; pixel-is-point files are moved by half a pixel."""
    width, height = d.need(WIDTH)[0], d.need(LENGTH)[0]
    pw, ph = (d.tags[SCALE] if SCALE in d.tags else (1.0, 1.0))[:2]
    i, j, _, x, y, _ = d.tags.get(TIEPOINT, (0.0,) * 6)[:6]
    keys = d.tags.get(GEO_KEYS, ())
    entry = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    ox, oy = x - i * pw, y + j * ph
    if entry.get(1025) == 2:
        ox, oy = ox - pw / 2, oy + ph / 2
    return Grid(width, height, pw, ox, oy, pw, ph, entry.get(2048, entry.get(3072, 0)))


@dataclass(frozen=True)
class Strip:
    row: int
    rows: int
    offset: int
    length: int


def strips(d: Directory) -> list[Strip]:
    """The strips of a plain GeoTIFF."""
    if d.one(COMPRESSION, 1) != 1:
        raise FormatError(f"compression {d.one(COMPRESSION)}")
    if d.one(PLANAR, 1) != 1:
        raise FormatError("bands in separate planes")
    height, per = d.need(LENGTH)[0], d.one(ROWS_PER_STRIP, d.need(LENGTH)[0])
    row_bytes = d.need(WIDTH)[0] * d.one(SAMPLES, 1) * sample_format(d).bytes
    out = []
    for k, offset in enumerate(d.need(STRIP_OFFSETS)):
        rows = min(per, height - k * per)
        out.append(Strip(k * per, rows, offset, rows * row_bytes))
    if sum(s.rows for s in out) != height:
        raise FormatError("strips don't cover the image")
    return out


def read_strip(source: RangeRead, d: Directory, strip: Strip) -> np.ndarray:
    """(rows, width, bands) with NaN for no data."""
    values = sample_format(d).decode(source.read_range(strip.offset, strip.length))
    values = values.reshape(strip.rows, d.need(WIDTH)[0], d.one(SAMPLES, 1))
    return np.where(values == _NO_DATA, np.nan, values)


@dataclass
class Level:
    """One resolution of a cloud-optimised GeoTIFF."""

    directory: Directory
    grid: Grid
    format: SampleFormat
    bands: int
    tile: tuple[int, int]
    compression: int
    predictor: int
    nodata: float | None
    mask: Level | None = field(default=None, repr=False)

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.tile[0])

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.tile[1])

    def span(self, tile: int) -> tuple[int, int]:
        return self.directory.tags[TILE_OFFSETS][tile], self.directory.tags[TILE_COUNTS][tile]

    def without_spans(self) -> Level:
        """The level without its directories, which list the places of all tiles."""
        return replace(self, directory=Directory({}, 0), mask=self.mask and self.mask.without_spans())


def _level(d: Directory, mask: bool = False) -> Level:
    width, height = d.need(WIDTH)[0], d.need(LENGTH)[0]
    if TILE_WIDTH not in d.tags or TILE_OFFSETS not in d.tags:
        raise FormatError("image isn't tiled")
    bands, compression, predictor = d.one(SAMPLES, 1), d.one(COMPRESSION, 1), d.one(PREDICTOR, 1)
    if compression not in (1, 8):
        raise FormatError(f"compression {compression}")
    if bands > 1 and d.one(PLANAR, 1) != 1:
        raise FormatError("bands in separate planes")
    fmt = SampleFormat("bit", "<u1", 1) if mask and d.one(BITS, 1) == 1 else sample_format(d)
    if predictor == 2 and (fmt.tag == 3 or fmt.bits > 32) or predictor == 3 and fmt.tag != 3 or predictor not in (1, 2, 3):
        raise FormatError(f"predictor {predictor} on {fmt.name}")
    nodata = nodata_value(d.one(NODATA)) if NODATA in d.tags else None
    grid = geometry(d)
    out = Level(d, grid, fmt, bands, (d.need(TILE_WIDTH)[0], d.need(TILE_LENGTH)[0]), compression, predictor, nodata)
    if not (out.across * out.down == len(d.need(TILE_OFFSETS)) == len(d.need(TILE_COUNTS))):
        raise FormatError(f"{len(d.tags[TILE_OFFSETS])} tiles for {width}x{height}")
    return out


def open_levels(source: RangeRead) -> list[Level]:
    """All resolutions, finest first, masks attached; only directories are read."""
    found = directories(source)
    masks = [_level(d, True) for d in found if d.one(SUBFILE, 0) & 4]
    images = [d for d in found if not d.one(SUBFILE, 0) & 4]
    if not images:
        raise FormatError("no image")
    levels = [_level(d) for d in images]
    base = levels[0].grid
    if SCALE not in images[0].tags or TIEPOINT not in images[0].tags:
        raise FormatError("the full image has no place")
    for level in levels[1:]:
        if SCALE not in level.directory.tags:
            fx, fy = base.width / level.grid.width, base.height / level.grid.height
            level.grid = Grid(level.grid.width, level.grid.height, base.pixel_width * fx, base.origin_x, base.origin_y, base.pixel_width * fx, base.pixel_height * fy, base.epsg)
        if level.nodata is None:
            level.nodata = levels[0].nodata
    if masks:
        shaped = {(m.grid.width, m.grid.height): m for m in masks}
        if any((x.grid.width, x.grid.height) not in shaped for x in levels):
            raise FormatError("masks for some levels only")
        for level in levels:
            level.mask = shaped[level.grid.width, level.grid.height]
    return levels


def _decompressed(level: Level, raw: bytes, size: int) -> bytes:
    try:
        data = zlib.decompress(raw) if level.compression == 8 else raw
    except zlib.error as e:
        raise FormatError(str(e)) from None
    if len(data) != size:
        raise FormatError(f"a tile of {len(data)} bytes, not {size}")
    return data


def decode_tile(level: Level, raw: bytes) -> np.ndarray:
    """(rows, columns, bands) of one tile with NaN for no data; no bytes give what a sparse tile stands for."""
    width, height = level.tile
    if not raw:
        return np.full((height, width, level.bands), np.nan if level.nodata is not None else 0.0)
    data = _decompressed(level, raw, width * height * level.bands * level.format.bytes)
    if level.predictor == 2:
        kind = level.format.dtype.replace("i", "u")
        data = np.cumsum(np.frombuffer(data, kind).reshape(height, width, level.bands), axis=1, dtype=np.dtype(kind)).tobytes()
    elif level.predictor == 3:
        size = level.format.bytes
        sums = np.frombuffer(data, np.uint8).reshape(height, -1, level.bands)
        planes = np.cumsum(sums, axis=1, dtype=np.uint8).reshape(height, size, width * level.bands)
        data = np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).tobytes()
    values = level.format.decode(data).reshape(height, width, level.bands)
    return values if level.nodata is None else np.where(values == level.nodata, np.nan, values)


def mask_tile(level: Level, raw: bytes) -> np.ndarray:
    """(rows, columns): True where pixels count; a tile without bytes masks all."""
    width, height = level.tile
    if not raw:
        return np.zeros((height, width), bool)
    if level.format.name == "bit":
        per_row = -(-width // 8)
        packed = np.frombuffer(_decompressed(level, raw, per_row * height), np.uint8).reshape(height, per_row)
        return np.unpackbits(packed, axis=1)[:, :width].astype(bool)
    return np.frombuffer(_decompressed(level, raw, width * height), np.uint8).reshape(height, width) > 0


def touched(level: Level, col0: int, row0: int, cols: int, rows: int) -> list[int]:
    """Tiles that a pixel box touches."""
    tw, th = level.tile
    c = range(max(0, col0) // tw, min(level.across - 1, (col0 + cols - 1) // tw) + 1)
    r = range(max(0, row0) // th, min(level.down - 1, (row0 + rows - 1) // th) + 1)
    return [y * level.across + x for y in r for x in c] if cols > 0 and rows > 0 else []


def read_tile(source: RangeRead, level: Level, tile: int, span: tuple[int, int] | None = None, mask: tuple[int, int] | None = None) -> tuple[int, int, np.ndarray]:
    """(row, col, values) of a tile cut to the image, masked pixels NaN in all bands; span and mask are the places of its bytes."""
    offset, count = span or level.span(tile)
    wanted = [(offset, count)] if count else []
    mask = mask or (level.mask.span(tile) if level.mask else (0, 0))
    got = iter(source.read_ranges(wanted + ([mask] if mask[1] else [])))
    return tile_of(level, tile, next(got) if count else b"", next(got) if mask[1] else b"")


def tile_of(level: Level, tile: int, body: bytes, mask: bytes) -> tuple[int, int, np.ndarray]:
    """(row, col, values) of a tile from its bytes and those of its mask."""
    values = decode_tile(level, body)
    if level.mask:
        values = np.where(mask_tile(level.mask, mask)[:, :, None], values, np.nan)
    row, col = tile // level.across * level.tile[1], tile % level.across * level.tile[0]
    return row, col, values[: level.grid.height - row, : level.grid.width - col]


def read_window(source: RangeRead, level: Level, col0: int, row0: int, cols: int, rows: int) -> np.ndarray:
    """(rows, cols, bands) of a pixel box; outside the image NaN."""
    out = np.full((rows, cols, level.bands), np.nan)
    for tile in touched(level, col0, row0, cols, rows):
        r, c, values = read_tile(source, level, tile)
        top, left = max(r, row0), max(c, col0)
        bottom, right = min(r + values.shape[0], row0 + rows), min(c + values.shape[1], col0 + cols)
        if top < bottom and left < right:
            out[top - row0 : bottom - row0, left - col0 : right - col0] = values[top - r : bottom - r, left - c : right - c]
    return out


# -- writing --


def _directory(entries: list[tuple[int, int, tuple | bytes]], at: int, following: int) -> bytes:
    """An image directory at a place of the file, with its longer values behind it."""
    entries = sorted(entries, key=lambda e: e[0])
    body, extra = [], b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        if len(raw) > 4:
            place = struct.pack("<I", behind + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        body.append(struct.pack("<HHI", tag, kind, len(raw) if kind == 2 else len(values)) + place)
    return struct.pack("<H", len(entries)) + b"".join(body) + struct.pack("<I", following) + extra


def _place(grid: Grid, factor: float = 1.0) -> list[tuple[int, int, tuple]]:
    return [(SCALE, 12, (grid.pixel_width * factor, grid.pixel_height * factor, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, grid.origin_x, grid.origin_y, 0.0))]


def geotiff_header(grid: Grid, bands: int, fmt: SampleFormat, plain: bool = False) -> bytes:
    """All of a one-strip GeoTIFF before its pixels. plain: the single-band f64 layout of fixed bytes."""
    geographic = grid.epsg < 5000
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, grid.epsg)
    size = grid.width * grid.height * bands * fmt.bytes
    if size + 65535 > 2**32 - 1:
        raise InvalidInput("image too large for a classic TIFF")
    if plain:
        entries = [(WIDTH, 3, grid.width), (LENGTH, 3, grid.height), (BITS, 3, 64), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIP_OFFSETS, 4, 8 + 162 + 96), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 3, grid.height), (STRIP_COUNTS, 4, size), (FORMAT, 3, 3)]
        out = struct.pack("<2sHIH", b"II", 42, 8, 13)
        for tag, kind, value in entries:
            out += struct.pack("<HHII", tag, kind, 1, value)
        out += struct.pack("<HHIIHHIIHHIII", SCALE, 12, 3, 170 + 48, TIEPOINT, 12, 6, 170, GEO_KEYS, 3, 12, 170 + 72, 0)
        return out + struct.pack("<9d12H", 0, 0, 0, grid.origin_x, grid.origin_y, 0, grid.pixel_width, grid.pixel_height, 0, *keys)
    rgb = bands >= 3
    extra = tuple(2 if rgb and k == 0 else 0 for k in range(bands - (3 if rgb else 1)))

    def build(offset: int) -> bytes:
        entries = [(WIDTH, 4, (grid.width,)), (LENGTH, 4, (grid.height,)), (BITS, 3, (fmt.bits,) * bands), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (2 if rgb else 1,)), (STRIP_OFFSETS, 4, (offset,)), (SAMPLES, 3, (bands,)), (ROWS_PER_STRIP, 4, (grid.height,)), (STRIP_COUNTS, 4, (size,)), (PLANAR, 3, (1,)), (FORMAT, 3, (fmt.tag,) * bands), (GEO_KEYS, 3, keys), *_place(grid)]
        if extra:
            entries.append((EXTRA, 3, extra))
        return struct.pack("<2sHI", b"II", 42, 8) + _directory(entries, 8, 0)

    return build(len(build(0)))


def level_sizes(grid: Grid, overviews: int) -> list[tuple[int, int]]:
    """(width, height) of each level, finest first; halves are rounded up."""
    out = [(grid.width, grid.height)]
    for _ in range(overviews):
        out.append(tuple(math.ceil(x / 2) for x in out[-1]))
    return out


def tile_order(n: int, levels: int) -> list[int]:
    """Levels in the order of their tiles in a file: images, coarsest first, and then masks."""
    return [*range(levels - 1, -1, -1), *range(n - 1, levels - 1, -1)]


def packed_mask(valid: np.ndarray) -> bytes:
    """A mask tile: a bit a pixel, rows from whole bytes on."""
    return np.packbits(valid, axis=1).tobytes()


def predicted(data: bytes, predictor: int, fmt: SampleFormat, tile: tuple[int, int], bands: int) -> bytes:
    """The samples of a tile as differences along its rows: 2 of whole numbers, 3 of the bytes of floating-point ones, high bytes first."""
    if predictor == 1:
        return data
    height = tile[1]
    if predictor == 2:
        kind = np.dtype(fmt.dtype.replace("i", "u"))
        values = np.frombuffer(data, kind).reshape(height, -1, bands).copy()
        values[:, 1:] -= values[:, :-1].copy()
        return values.tobytes()
    planes = np.frombuffer(data, np.uint8).reshape(height, -1, fmt.bytes)[:, :, ::-1].transpose(0, 2, 1).reshape(height, -1, bands).copy()
    planes[:, 1:] -= planes[:, :-1].copy()
    return planes.tobytes()


def check_predictor(fmt: SampleFormat, predictor: int) -> None:
    if predictor == 2 and (fmt.tag == 3 or fmt.bits > 32) or predictor == 3 and fmt.tag != 3 or predictor not in (1, 2, 3):
        raise InvalidInput(f"predictor {predictor} on {fmt.name}")


def cog_header(grid: Grid, sizes: list[tuple[int, int]], bands: int, fmt: SampleFormat, tile: tuple[int, int], deflate: bool, nodata: float | None, counts: list[list[int]], predictor: int = 1) -> bytes:
    """All directories of a cloud-optimised GeoTIFF, finest first; tiles follow, coarsest level first.

    A tile of no bytes has no place either: readers take it for nodata. Where counts are of
    twice as many levels, the second half is of masks, a bit a pixel, whose directories and
    tiles come behind those of the images.
    """
    check_nodata(fmt, nodata)
    check_predictor(fmt, predictor)
    geographic = 4000 <= grid.epsg <= 4999
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, grid.epsg)

    def image(k: int) -> list[tuple[int, int, tuple | bytes]]:
        entries = [(BITS, 3, (fmt.bits,) * bands), (COMPRESSION, 3, (8 if deflate else 1,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (bands,)), (FORMAT, 3, (fmt.tag,) * bands), (GEO_KEYS, 3, keys), *_place(grid, 2.0**k)]
        if k:
            entries.append((SUBFILE, 4, (1,)))
        if bands > 1:
            entries += [(PLANAR, 3, (1,)), (EXTRA, 3, (0,) * (bands - 1))]
        if predictor > 1:
            entries.append((PREDICTOR, 3, (predictor,)))
        if nodata is not None:
            entries.append((NODATA, 2, nodata_text(nodata).encode() + b"\0"))
        return entries

    def mask(k: int) -> list[tuple[int, int, tuple | bytes]]:
        return [(BITS, 3, (1,)), (COMPRESSION, 3, (8 if deflate else 1,)), (PHOTOMETRIC, 3, (4,)), (SAMPLES, 3, (1,)), (SUBFILE, 4, (5 if k else 4,))]

    def build(offsets: list[list[int]]) -> bytes:
        out = struct.pack("<2sHI", b"II", 42, 8)
        for n in range(len(counts)):
            k = n % len(sizes)
            width, height = sizes[k]
            shape = [(WIDTH, 3 if width < 65536 else 4, (width,)), (LENGTH, 3 if height < 65536 else 4, (height,)), (TILE_WIDTH, 3, (tile[0],)), (TILE_LENGTH, 3, (tile[1],)), (TILE_OFFSETS, 4, tuple(offsets[n])), (TILE_COUNTS, 4, tuple(counts[n]))]
            entries = shape + (image(k) if n < len(sizes) else mask(k))
            size = len(_directory(entries, 0, 0))
            out += _directory(entries, len(out), len(out) + size if n + 1 < len(counts) else 0)
        return out

    at, offsets = len(build(counts)), [[0] * len(c) for c in counts]
    for k in tile_order(len(counts), len(sizes)):
        for n, count in enumerate(counts[k]):
            offsets[k][n] = at if count else 0
            at += count
    if at > 2**32 - 1:
        raise InvalidInput("image too large for a classic TIFF, whose offsets have 32 bits")
    return build(offsets)
