"""Classic NetCDF files (CDF-1 and CDF-2)."""

from __future__ import annotations

import math

import numpy as np

from gridweft.functions.grid import FormatError
from gridweft.sources.samples import RangeRead, unpack

#: Big-endian NumPy types of NetCDF types; bytes are read as unsigned.
TYPES = {1: ("byte", ">u1"), 2: ("char", ">u1"), 3: ("short", ">i2"), 4: ("int", ">i4"), 5: ("float", ">f4"), 6: ("double", ">f8")}


class _Header:
    """Sequential reads of a header."""

    def __init__(self, source: RangeRead):
        self.source, self.at = source, 4

    def take(self, n: int) -> bytes:
        data = self.source.read_range(self.at, n)
        self.at += n
        return data

    def int32(self) -> int:
        return unpack(">I", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        try:
            return self.padded(self.int32()).decode()
        except UnicodeDecodeError as e:
            raise FormatError(str(e)) from None

    def items(self, read) -> list:
        _, count = self.int32(), self.int32()
        return [read() for _ in range(count)]

    def attribute(self) -> tuple[str, dict]:
        name, kind, n = self.name(), self.int32(), self.int32()
        label, dtype = TYPES.get(kind, TYPES[1])
        raw = self.padded(n * np.dtype(dtype).itemsize)
        if label == "char":
            return name, {"nc_type": label, "text": raw.decode("utf-8", "replace").rstrip("\0"), "nums": None}
        return name, {"nc_type": label, "text": None, "nums": np.frombuffer(raw, dtype).astype(float).tolist()}


def metadata(source: RangeRead) -> dict:
    """Dimensions, variables and attributes; no data is read."""
    magic = source.read_range(0, 4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise FormatError("not a classic NetCDF file")
    h = _Header(source)
    h.int32()  # number of records
    dims = h.items(lambda: {"name": h.name(), "size": h.int32()})
    for d in dims:
        d["is_unlimited"] = d["size"] == 0
    attributes = dict(h.items(h.attribute))

    def variable() -> dict:
        name = h.name()
        ids = [h.int32() for _ in range(h.int32())]
        known = [dims[k] for k in ids if k < len(dims)]
        own = dict(h.items(h.attribute))
        kind = h.int32()
        h.int32()  # padded size
        begin = unpack(">Q", h.take(8))[0] if magic[3] == 2 else h.int32()
        return {"name": name, "data_type": TYPES.get(kind, TYPES[5])[0], "dimensions": [d["name"] for d in known], "shape": [d["size"] for d in known], "begin": begin, "attributes": own}

    return {"dimensions": dims, "variables": h.items(variable), "global_attributes": attributes}


def number(attributes: dict, name: str) -> float | None:
    found = attributes.get(name)
    return found["nums"][0] if found and found["nums"] and found["nc_type"] != "byte" else None


def find(meta: dict, name: str) -> dict:
    for v in meta["variables"]:
        if v["name"] == name:
            if len(v["shape"]) < 2:
                raise FormatError(f"variable {name!r} has fewer than 2 dimensions")
            if 0 in v["shape"]:
                raise FormatError(f"variable {name!r} runs along an unlimited dimension")
            return v
    raise FormatError(f"no variable {name!r}")


def cell_size(meta: dict, variable: dict) -> float:
    """360 degrees over the cells of a coordinate in degrees, else 1."""
    for v in meta["variables"]:
        if v["name"] == variable["dimensions"][-1] and len(v["shape"]) == 1:
            units = v["attributes"].get("units", {}).get("text") or ""
            return 360.0 / v["shape"][0] if v["shape"][0] > 1 and "degree" in units else 1.0
    return 1.0


def read_rows(source: RangeRead, variable: dict, row: int, rows: int) -> np.ndarray:
    """(rows, width) of the last 2-D slice, scaled; NaN for fill values."""
    dtype = next(t for label, t in TYPES.values() if label == variable["data_type"])
    *leading, height, width = variable["shape"]
    skip = (math.prod(leading) - 1) * height * width if leading else 0
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(source.read_range(variable["begin"] + (skip + row * width) * size, rows * width * size), dtype).astype(np.float64).reshape(rows, width)
    own = variable["attributes"]
    fill, scale, offset = number(own, "_FillValue"), number(own, "scale_factor"), number(own, "add_offset")
    values = raw * (1.0 if scale is None else scale) + (0.0 if offset is None else offset)
    return values if fill is None else np.where(np.abs(raw - fill) < np.finfo(float).eps, np.nan, values)
