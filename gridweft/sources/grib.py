"""GRIB edition 2 messages in simple packing."""

from __future__ import annotations

import numpy as np

from gridweft.functions.grid import FormatError, Grid
from gridweft.sources.samples import RangeRead, unpack

#: Code tables of grid templates, time units and packings.
TEMPLATES = {0: "lat_lon", 1: "rotated_lat_lon", 10: "mercator", 20: "polar_stereographic", 30: "lambert_conformal", 40: "gaussian_lat_lon"}
TIME_UNITS = {0: "minute", 1: "hour", 2: "day", 3: "month", 4: "year"}
PACKINGS = {0: "simple", 2: "complex", 3: "complex_spatial_diff", 40: "jpeg2000", 41: "png"}
_LOOK_AHEAD = 10_240
#: Fixed value: what stands for no data.
MISSING = 9999.0


def _message(source: RangeRead, at: int, size: int, discipline: int, edition: int) -> dict:
    found = {"discipline": discipline, "edition": edition, "offset": at, "reference_time": None, "grid": None, "product": None, "packing": "unknown", "simple": None, "data_offset": None, "data_length": None}
    place, end = at + 16, at + size
    while place + 4 <= end:
        head = source.read_range(place, 4)
        if head == b"7777":
            break
        (length,) = unpack(">I", head)
        if length < 5 or place + length > end:
            raise FormatError("a GRIB section of wrong length")
        number, start, body_len = source.read_range(place + 4, 1)[0], place + 5, length - 5
        body = b"" if number == 7 else source.read_range(start, body_len)
        if number == 1:
            found["reference_time"] = dict(zip(("year", "month", "day", "hour", "minute", "second"), unpack(">HBBBBB", body, 7), strict=True))
        elif number == 3:
            if len(body) < 70:
                raise FormatError("GRIB grid definition too short")
            (template,), (ni, nj), (angle, parts) = unpack(">H", body, 10), unpack(">II", body, 28), unpack(">II", body, 36)
            scale = angle / parts if angle and parts else 1e-6
            lat1, lon1 = unpack(">ii", body, 44)
            lat2, lon2, di, dj = unpack(">iiII", body, 53)
            found["grid"] = {"template": TEMPLATES.get(template, f"unknown_{template}"), "ni": ni, "nj": nj, "lat_first": lat1 * scale, "lon_first": lon1 * scale, "lat_last": lat2 * scale, "lon_last": lon2 * scale, "di": di * scale, "dj": dj * scale, "scan_mode": body[69]}
        elif number == 4:
            if len(body) < 6:
                raise FormatError("GRIB product definition too short")
            product = {"category": body[4], "number": body[5], "process": body[6] if len(body) > 6 else 0, "forecast_time": 0, "time_unit": "hour", "level_type": 0, "level_value": 0.0}
            if len(body) >= 23:
                (scale,), (value,) = unpack(">b", body, 18), unpack(">i", body, 19)
                product |= {"time_unit": TIME_UNITS.get(body[12], f"unknown_{body[12]}"), "forecast_time": unpack(">I", body, 13)[0], "level_type": body[17], "level_value": value * 10.0**-scale}
            found["product"] = product
        elif number == 5:
            (template,) = unpack(">H", body, 4)
            found["packing"] = PACKINGS.get(template, f"unknown_{template}")
            if template == 0:
                found["simple"] = dict(zip(("reference", "binary", "decimal", "bits"), unpack(">fhhB", body, 6), strict=True))
        elif number == 7:
            found |= {"data_offset": start, "data_length": body_len}
        place += length
    if not found["grid"] or not found["grid"]["ni"] or not found["grid"]["nj"] or found["data_offset"] is None:
        raise FormatError("a GRIB message without grid or data")
    return found


def scan(source: RangeRead, size: int) -> list[dict]:
    """The edition 2 messages of a file of so many bytes; pixels aren't read."""
    out, at = [], 0
    while at + 16 <= size:
        head = source.read_range(at, 16)
        if head[:4] != b"GRIB":
            near = source.read_range(at + 4, min(_LOOK_AHEAD, size - at - 4)).find(b"GRIB")
            if near < 0:
                break
            at += 4 + near
            continue
        edition = head[7]
        length = unpack(">Q", head, 8)[0] if edition == 2 else int.from_bytes(head[8:12], "big")
        if length < 16:
            break
        if edition == 2:
            out.append(_message(source, at, length, head[6], edition))
        at += length
    return out


def geometry(message: dict) -> Grid:
    """Shape and cell size of a message: the increment along a parallel."""
    g = message["grid"]
    return Grid(g["ni"], g["nj"], g["di"], pixel_width=g["di"], pixel_height=g["dj"])


def decode(source: RangeRead, message: dict) -> np.ndarray:
    """(nj, ni) values (R + X * 2^E) / 10^D of a message in simple packing; NaN where that is 9999 and past the data's end."""
    p = message["simple"]
    if not p:
        raise FormatError(f"packing {message['packing']}")
    nj, ni = message["grid"]["nj"], message["grid"]["ni"]
    n, bits = nj * ni, p["bits"]
    if bits == 0:
        return np.full((nj, ni), np.nan if p["reference"] == MISSING else p["reference"])
    raw = np.frombuffer(source.read_range(message["data_offset"], message["data_length"]), np.uint8)
    whole = min(n, len(raw) * 8 // bits)
    flat = np.unpackbits(raw)[: whole * bits].reshape(whole, bits)
    numbers = np.zeros(whole, np.float64)
    for k in range(bits):
        numbers = numbers * 2 + flat[:, k]
    out = np.full(n, np.nan)
    out[:whole] = (p["reference"] + numbers * float(np.float32(2.0) ** p["binary"])) * 10.0 ** -p["decimal"]
    return np.where(out == MISSING, np.nan, out).reshape(nj, ni)
