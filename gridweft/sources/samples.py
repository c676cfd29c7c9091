"""Sample formats of raster files and positional reads of their bytes."""

from __future__ import annotations

import os
import struct
import urllib.error
import urllib.request
from dataclasses import dataclass

import numpy as np

from gridweft.functions.grid import FormatError, InvalidInput


@dataclass(frozen=True)
class SampleFormat:
    name: str
    dtype: str
    tag: int  # TIFF SampleFormat: 1 unsigned, 2 signed, 3 float

    @property
    def bits(self) -> int:
        return np.dtype(self.dtype).itemsize * 8

    @property
    def bytes(self) -> int:
        return self.bits // 8

    @property
    def integer_range(self) -> tuple[int, int] | None:
        if self.tag == 3:
            return None
        info = np.iinfo(self.dtype)
        return int(info.min), int(info.max)

    def encode(self, values: np.ndarray) -> bytes:
        """Little-endian samples; integers are rounded half away from zero and clamped, NaN becomes 0."""
        if self.tag == 3:
            return values.astype(self.dtype).tobytes()
        low, high = self.integer_range
        whole = np.nan_to_num(np.copysign(np.floor(np.abs(values) + 0.5), values), nan=0.0, posinf=high, neginf=low)
        return np.clip(whole, low, high).astype(self.dtype).tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype).astype(np.float64)


FORMATS = {f.name: f for f in (SampleFormat(*x) for x in (("u8", "<u1", 1), ("i8", "<i1", 2), ("u16", "<u2", 1), ("i16", "<i2", 2), ("u32", "<u4", 1), ("i32", "<i4", 2), ("f32", "<f4", 3), ("f64", "<f8", 3)))}


def format_named(name: str) -> SampleFormat:
    if name not in FORMATS:
        raise InvalidInput(f"unknown sample format {name!r}")
    return FORMATS[name]


def format_of(bits: int, tag: int) -> SampleFormat:
    for f in FORMATS.values():
        if (f.bits, f.tag) == (bits, tag):
            return f
    raise FormatError(f"samples of {bits} bits and format {tag}")


def check_nodata(fmt: SampleFormat, nodata: float | None) -> None:
    """An integer format needs a whole value in its range, f32 one that survives narrowing."""
    if nodata is None:
        return
    if fmt.integer_range:
        low, high = fmt.integer_range
        if not (np.isfinite(nodata) and nodata == int(nodata) and low <= nodata <= high):
            raise InvalidInput(f"nodata {nodata} in {fmt.name}")
    elif fmt.name == "f32" and nodata == nodata and float(np.float32(nodata)) != nodata:
        raise InvalidInput(f"nodata {nodata} in f32")


def nodata_text(value: float) -> str:
    if value != value:
        return "nan"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def nodata_value(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


class RangeRead:
    """Positional reads of a source; transports of remote stores subclass it."""

    def read_range(self, offset: int, length: int) -> bytes:
        raise NotImplementedError

    def size(self) -> int:
        raise NotImplementedError

    def read_ranges(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        return [self.read_range(o, n) for o, n in ranges]


def coalesced(ranges: list[tuple[int, int]], gap: int) -> list[tuple[int, int, list[int]]]:
    """(offset, length, which) of fewer ranges that hold all, joined where at most `gap` bytes lie between two."""
    out: list[tuple[int, int, list[int]]] = []
    for k in sorted(range(len(ranges)), key=lambda k: ranges[k]):
        offset, length = ranges[k]
        if out and offset <= out[-1][0] + out[-1][1] + gap:
            low, n, which = out[-1]
            out[-1] = (low, max(n, offset + length - low), [*which, k])
        else:
            out.append((offset, length, [k]))
    return out


class RemoteRange(RangeRead):
    """Reads whose requests cost more than bytes: ranges near each other are fetched by one request."""

    gap = 64 << 10

    def read_ranges(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        found = [b""] * len(ranges)
        for low, length, which in coalesced(ranges, self.gap):
            body = self.read_range(low, length)
            for k in which:
                offset, n = ranges[k]
                found[k] = body[offset - low : offset - low + n]
        return found


class HttpRange(RemoteRange):
    """A file behind http or https, by Range requests; the option transport=gridweft.sources.samples:HttpRange."""

    timeout = 60.0

    def __init__(self, path: str):
        self.path = path

    def _open(self, headers: dict[str, str], method: str = "GET"):
        try:
            return urllib.request.urlopen(urllib.request.Request(self.path, headers=headers, method=method), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise FormatError(f"{self.path}: {e.code}") from None

    def size(self) -> int:
        with self._open({}, "HEAD") as answer:
            return int(answer.headers["Content-Length"])

    def read_range(self, offset: int, length: int) -> bytes:
        if not length:
            return b""
        with self._open({"Range": f"bytes={offset}-{offset + length - 1}"}) as answer:
            body = answer.read(length) if answer.status == 206 else answer.read()[offset : offset + length]
        if len(body) != length:
            raise FormatError(f"{length} bytes at {offset} of {self.path}")
        return body


class BytesRange(RangeRead):
    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_range(self, offset: int, length: int) -> bytes:
        if offset + length > len(self.data):
            raise FormatError(f"{length} bytes at {offset} of {len(self.data)}")
        return self.data[offset : offset + length]


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class FileRange(RangeRead):
    def __init__(self, path: str):
        self.path = local_path(path)

    def size(self) -> int:
        return os.path.getsize(self.path)

    def read_range(self, offset: int, length: int) -> bytes:
        fd = os.open(self.path, os.O_RDONLY)
        try:
            data = os.pread(fd, length, offset)
        finally:
            os.close(fd)
        if len(data) != length:
            raise FormatError(f"{length} bytes at {offset} of {self.path}")
        return data


class RangeWrite:
    """Positional writes to one object that all executors see; transports of remote stores subclass it.

    A store that can rename says so by `renames`; objects are then written under another name first.
    """

    renames = False

    def rename(self, path: str) -> None:
        raise NotImplementedError

    def remove(self) -> None:
        raise NotImplementedError

    def create(self, head: bytes) -> None:
        """A new object that begins with these bytes."""
        raise NotImplementedError

    def write_range(self, offset: int, body) -> None:
        raise NotImplementedError


class FileWrite(RangeWrite):
    """A file in a folder that driver and executors share. A task that runs again writes the same bytes."""

    renames = True

    def __init__(self, path: str):
        self.path = local_path(path)

    def rename(self, path: str) -> None:
        os.replace(self.path, local_path(path))

    def remove(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)

    def create(self, head: bytes) -> None:
        with open(self.path, "wb") as out:
            out.write(head)

    def write_range(self, offset: int, body) -> None:
        fd = os.open(self.path, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            view = memoryview(body)
            while len(view):
                n = os.pwrite(fd, view, offset)
                view, offset = view[n:], offset + n
        finally:
            os.close(fd)


def unpack(kind: str, data: bytes, offset: int = 0) -> tuple:
    try:
        return struct.unpack_from(kind, data, offset)
    except struct.error as e:
        raise FormatError(str(e)) from None
