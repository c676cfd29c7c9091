import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.functions import flat
from gridweft.functions import grid as G
from gridweft.sources import grib, netcdf, samples, spark as S, tiff

ND = -9999.0


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    S.register(spark)


def cells(spark, array):
    rows, cols = array.shape
    return G.from_values(spark, array.reshape(-1).tolist(), cols, rows)


def back(df, rows, cols, band=0):
    out = np.full((rows, cols), np.nan)
    for r in df.where(F.col("band") == band).collect():
        out[r["row"], r["col"]] = math.nan if r["value"] is None else r["value"]
    return out


def ramp(rows, cols):
    return (np.arange(rows * cols) % 251 * 1.0).reshape(rows, cols)


def test_sample_formats():
    u8 = samples.FORMATS["u8"]
    assert list(u8.encode(np.array([300, -5, 12.6, np.nan, 255, 0.4]))) == [255, 0, 13, 0, 255, 0]
    for fmt in samples.FORMATS.values():
        values = np.array([0, 12, 100, 5, 64, 1.0])
        assert (fmt.decode(fmt.encode(values)) == values).all()
        assert samples.format_of(fmt.bits, fmt.tag) is fmt
    assert list(samples.FORMATS["i8"].decode(samples.FORMATS["i8"].encode(np.array([-127.75])))) == [-128]
    for name, bad in (("u8", 256), ("u8", 0.5), ("i16", math.nan), ("f32", 0.1)):
        with pytest.raises(G.InvalidInput):
            samples.check_nodata(samples.FORMATS[name], bad)
    assert [samples.nodata_text(v) for v in (-9999.0, math.nan, math.inf, -9999.25)] == ["-9999", "nan", "inf", "-9999.25"]
    assert samples.nodata_value("x") is None
    with pytest.raises(G.InvalidInput):
        samples.format_named("u128")


def test_plain_geotiff_bytes(spark, tmp_path):
    grid = G.Grid(3, 2, 10.0, 500000.0, 4500000.0, 10.0, 10.0, 32632)
    path = str(tmp_path / "a.tif")
    S.write_geotiff(G.from_values(spark, [1.5, -2.25, 3, 4.125, ND, 6.5], 3, 2, ND), path, grid, plain=True)
    data = open(path, "rb").read()
    assert len(data) == 8 + 162 + 96 + 48
    assert data[-48:] == struct.pack("<6d", 1.5, -2.25, 3, 4.125, ND, 6.5)
    assert struct.unpack_from("<H", data, 8) == (13,)
    found = back(spark.read.format("geotiff").option("path", path).load(), 2, 3)
    assert np.array_equal(found, [[1.5, -2.25, 3], [4.125, np.nan, 6.5]], equal_nan=True)
    d = tiff.directories(samples.FileRange(path))[0]
    assert tiff.geometry(d) == grid


@pytest.mark.parametrize(("bands", "photometric", "extra"), [(1, 1, None), (2, 1, (0,)), (3, 2, None), (4, 2, (2,))])
def test_banded_geotiff(spark, tmp_path, bands, photometric, extra):
    path, grid = str(tmp_path / "b.tif"), G.Grid(5, 700)
    layers = [ramp(700, 5) + k for k in range(bands)]
    S.write_geotiff(G.banded([cells(spark, x) for x in layers]), path, grid, bands, "u16")
    d = tiff.directories(samples.FileRange(path))[0]
    assert (d.one(tiff.PHOTOMETRIC), d.tags.get(tiff.EXTRA)) == (photometric, extra)
    read = spark.read.format("geotiff").option("path", path).load()
    for k, layer in enumerate(layers):
        assert np.array_equal(back(read, 700, 5, k), layer)
    assert spark.read.format("geotiff").option("path", path).option("row_min", 3).option("row_max", 4).load().select("row").distinct().count() == 2


def test_tiepoints():
    def place(i, j, point):
        keys = (1, 1, 0, 1, 1025, 0, 1, 2) if point else ()
        d = tiff.Directory({tiff.WIDTH: (4,), tiff.LENGTH: (4,), tiff.SCALE: (10.0, 10.0, 0.0), tiff.TIEPOINT: (i, j, 0.0, 500000.0, 4500000.0, 0.0), tiff.GEO_KEYS: keys}, 0)
        g = tiff.geometry(d)
        return g.origin_x, g.origin_y

    assert place(3.0, 2.0, False) == (499970, 4500020)
    assert place(0.0, 0.0, True) == (499995, 4500005)
    assert place(3.0, 2.0, True) == (499965, 4500025)


def test_wrong_files(tmp_path):
    with pytest.raises(G.FormatError):
        tiff.directories(samples.BytesRange(b"MM\0*\0\0\0\x08"))
    with pytest.raises(G.FormatError):
        tiff.directories(samples.BytesRange(b"II*\0\x08\0\0\0\x05\0"))
    squeezed = tiff.Directory({tiff.COMPRESSION: (5,)}, 0)
    with pytest.raises(G.FormatError):
        tiff.strips(squeezed)


class Counting(samples.RangeRead):
    def __init__(self, path):
        self.inner, self.read = samples.FileRange(path), 0

    def read_range(self, offset, length):
        self.read += length
        return self.inner.read_range(offset, length)


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("bands", [1, 3])
def test_cog_round_trip(spark, tmp_path, deflate, bands):
    path, grid = str(tmp_path / "c.tif"), G.Grid(40, 30, 0.5, 10.0, 50.0, 0.5, 0.5, 4326)
    layers = [ramp(30, 40) + k for k in range(bands)]
    S.write_cog(G.banded([cells(spark, x) for x in layers]), path, grid, bands, "f32", (16, 16), 2, deflate)
    levels = tiff.open_levels(samples.FileRange(path))
    assert [(x.grid.width, x.grid.height) for x in levels] == [(40, 30), (20, 15), (10, 8)]
    assert levels[0].grid.origin_y == 50.0 and levels[1].grid.pixel_width == 1.0
    starts = [x.span(0)[0] for x in levels]
    assert starts == sorted(starts, reverse=True)
    for k, layer in enumerate(layers):
        assert np.array_equal(back(spark.read.format("cog").option("path", path).load(), 30, 40, k), layer)
        half = layer.reshape(15, 2, 20, 2).mean((1, 3))
        assert np.allclose(back(spark.read.format("cog").option("path", path).option("resolution", 1.2).load(), 15, 20, k), half)
    box = tiff.read_window(samples.FileRange(path), levels[0], 7, 5, 20, 40)
    assert np.array_equal(box[:25, :, 0], layers[0][5:30, 7:27]) and np.isnan(box[25:]).all()


def test_cog_windows_read_little(spark, tmp_path):
    path, grid = str(tmp_path / "w.tif"), G.Grid(256, 256)
    S.write_cog(cells(spark, ramp(256, 256)), path, grid, tile=(16, 16), overviews=0)
    source = Counting(path)
    level = tiff.open_levels(source)[0]
    tiff.read_window(source, level, 40, 40, 16, 16)
    assert source.read < (tmp_path / "w.tif").stat().st_size / 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("cog").option("path", path).option("push", "true").load().where("row >= 3 and row <= 5 and col = 20")
        assert df.rdd.getNumPartitions() == 1
        assert df.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_cog_nodata(spark, tmp_path):
    path, grid = str(tmp_path / "n.tif"), G.Grid(4, 4)
    holes = ramp(4, 4)
    holes[1, 2] = np.nan
    with pytest.raises(Exception, match="need a nodata value"):
        S.write_cog(cells(spark, holes), path, grid, sample_format="u8", tile=(16, 16), overviews=0, nodata=None)
    S.write_cog(cells(spark, holes), path, grid, sample_format="i16", tile=(16, 16), overviews=1, nodata=-9999.0)
    assert np.array_equal(back(spark.read.format("cog").option("path", path).load(), 4, 4), holes, equal_nan=True)
    assert tiff.open_levels(samples.FileRange(path))[1].nodata == -9999.0


def test_streamed_tiles(spark, tmp_path):
    grid, kept = G.Grid(37, 21), {}
    path, other = str(tmp_path / "s.tif"), str(tmp_path / "t.tif")
    layer = cells(spark, ramp(21, 37))
    S.write_cog(layer, path, grid, 1, "u16", (16, 16), 2, True, 0.0)
    for r in S.encoded_tiles(layer, grid, 1, "u16", (16, 16), 2, False, 0.0).collect():
        kept[r["level"], r["tile"]] = r["body"]
    order = []

    def produce(level, c, r):
        order.append(level)
        return kept[level, r * -(-tiff.level_sizes(grid, 2)[level][0] // 16) + c]

    S.write_cog_tiles(other, grid, 1, "u16", (16, 16), 2, True, 0.0, produce)
    assert open(path, "rb").read() == open(other, "rb").read()
    assert order == [2] + [1] * 2 + [0] * 6


def level(fmt, predictor=1, compression=1, nodata=None, bands=1, size=4, counts=(1,)):
    d = tiff.Directory({tiff.TILE_OFFSETS: (0,), tiff.TILE_COUNTS: counts}, 0)
    return tiff.Level(d, G.Grid(size, size), samples.FORMATS[fmt], bands, (size, size), compression, predictor, nodata)


def test_predictors():
    values = np.arange(16).reshape(4, 4) * 7 % 50
    for fmt in ("u8", "i16", "u32"):
        kind = samples.FORMATS[fmt].dtype
        raw = np.diff(values.astype(kind), axis=1, prepend=np.zeros((4, 1), kind)).astype(kind).tobytes()
        assert np.array_equal(tiff.decode_tile(level(fmt, 2, 8), zlib.compress(raw))[:, :, 0], values)
    floats = (values * 1.25).astype("<f4")
    planes = floats.view(np.uint8).reshape(4, 4, 4).transpose(0, 2, 1)[:, ::-1].reshape(4, 16)
    raw = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8).tobytes()
    assert np.array_equal(tiff.decode_tile(level("f32", 3), raw)[:, :, 0], floats)
    with pytest.raises(G.FormatError):
        tiff.decode_tile(level("u8"), b"abc")


def test_sparse_tiles_and_masks():
    assert (tiff.decode_tile(level("u8"), b"") == 0).all()
    assert np.isnan(tiff.decode_tile(level("u8", nodata=0.0), b"")).all()
    bit = tiff.Level(tiff.Directory({}, 0), G.Grid(4, 4), samples.SampleFormat("bit", "<u1", 1), 1, (4, 4), 1, 1, None)
    assert tiff.mask_tile(bit, bytes([0b10100000] * 4)).tolist() == [[True, False, True, False]] * 4
    assert not tiff.mask_tile(bit, b"").any()
    assert tiff.mask_tile(level("u8"), bytes(range(16))).sum() == 15


def section(number, body):
    return struct.pack(">IB", len(body) + 5, number) + body


def grib_bytes(bits=8, data=bytes([0, 10, 20, 30]), reference=10.0):
    one = struct.pack(">HHBBBHBBBBBBB", 0, 0, 2, 0, 1, 2024, 1, 15, 12, 0, 0, 0, 1)
    three = bytearray(70)
    struct.pack_into(">II", three, 28, 2, 2)
    struct.pack_into(">ii", three, 44, 1_000_000, 0)
    struct.pack_into(">iiII", three, 53, 0, 1_000_000, 1_000_000, 1_000_000)
    four = bytearray(28)
    five = struct.pack(">IHfhhBB", 4, 0, reference, 0, 0, bits, 0)
    body = section(1, one) + section(3, bytes(three)) + section(4, bytes(four)) + section(5, five) + section(6, b"\xff") + section(7, data) + b"7777"
    return b"GRIB" + struct.pack(">HBBQ", 0, 0, 2, 16 + len(body)) + body


def test_grib(spark, tmp_path):
    data = grib_bytes() + b"junk" * 3 + grib_bytes(0, b"", 293.15)
    found = grib.scan(samples.BytesRange(data), len(data))
    assert len(found) == 2
    assert found[0]["grid"]["lat_first"] == 1 and found[0]["grid"]["di"] == 1
    assert found[0]["reference_time"] == {"year": 2024, "month": 1, "day": 15, "hour": 12, "minute": 0, "second": 0}
    assert grib.decode(samples.BytesRange(data), found[0]).tolist() == [[10, 20], [30, 40]]
    assert np.allclose(grib.decode(samples.BytesRange(data), found[1]), 293.15)
    short = grib_bytes(8, bytes([1, 2]))
    assert np.isnan(grib.decode(samples.BytesRange(short), grib.scan(samples.BytesRange(short), len(short))[0])).sum() == 2
    path = tmp_path / "m.grib2"
    path.write_bytes(data)
    df = spark.read.format("grib2").option("path", str(path)).load()
    assert df.count() == 8
    assert back(df, 2, 2).tolist() == [[10, 20], [30, 40]]
    with pytest.raises(G.FormatError):
        grib.decode(samples.BytesRange(b""), {"packing": "jpeg2000", "simple": None, "grid": {"ni": 1, "nj": 1}})


def netcdf_bytes(version=1, attributes=()):
    def name(text):
        raw = text.encode()
        return struct.pack(">I", len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")

    def attribute(key, value):
        if isinstance(value, str):
            return name(key) + struct.pack(">II", 2, len(value)) + value.encode().ljust(-(-len(value) // 4) * 4, b"\0")
        return name(key) + struct.pack(">IId", 6, 1, value)

    def variable(key, begin, own):
        listed = struct.pack(">II", 12, len(own)) + b"".join(attribute(k, v) for k, v in own) if own else struct.pack(">II", 0, 0)
        return name(key) + struct.pack(">III", 2, 0, 1) + listed + struct.pack(">II", 5, 16) + struct.pack(">Q" if version == 2 else ">I", begin)

    def head(begin):
        out = b"CDF" + bytes([version]) + struct.pack(">I", 0)
        out += struct.pack(">II", 10, 2) + name("y") + struct.pack(">I", 2) + name("x") + struct.pack(">I", 2)
        out += struct.pack(">II", 12, 1) + attribute("title", "made here")
        return out + struct.pack(">II", 11, 2) + variable("temp", begin, attributes) + variable("precip", begin + 16, ())

    size = len(head(0))
    return head(size) + struct.pack(">8f", 1, 2, 3, 4, 10, 20, 30, 40)


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf(spark, tmp_path, version):
    path = tmp_path / "a.nc"
    path.write_bytes(netcdf_bytes(version, (("scale_factor", 2.0), ("add_offset", 1.0), ("_FillValue", 3.0))))
    meta = netcdf.metadata(samples.FileRange(str(path)))
    assert [v["name"] for v in meta["variables"]] == ["temp", "precip"]
    assert meta["global_attributes"]["title"]["text"] == "made here"
    assert netcdf.cell_size(meta, meta["variables"][0]) == 1.0
    read = spark.read.format("netcdf").option("path", str(path))
    assert back(read.option("variable", "precip").load(), 2, 2).tolist() == [[10, 20], [30, 40]]
    assert np.array_equal(back(read.option("variable", "temp").load(), 2, 2), [[3, 5], [np.nan, 9]], equal_nan=True)
    with pytest.raises(G.FormatError):
        netcdf.find(meta, "wind")
    with pytest.raises(G.FormatError):
        netcdf.metadata(samples.BytesRange(b"\x89HDF"))


def test_flat_functions(spark):
    f = flat.RasterFunctions(spark)
    assert f.reclassify([1, 5, 15, 25], 2, 2, ND, [0, 10, 1, 10, 20, 2, 20, 30, 3]) == [1, 1, 2, 3]
    with pytest.raises(G.InvalidInput):
        f.reclassify([1], 1, 1, ND, [0, 1])
    polygons = f.polygonize([5, 5, 5, 5], 2, 2, 1.0, ND)
    assert polygons == [5, 1, 5, 0, 0, 2, 0, 2, 2, 0, 2, 0, 0]
    assert flat.read_flat_polygons(polygons)[0][0] == 5
    assert f.rasterize(polygons, 2, 2, [0, 0, 2, 2]) == [5] * 4
    with pytest.raises(G.InvalidInput):
        flat.read_flat_polygons(polygons[:-3])
    with pytest.raises(G.InvalidInput):
        f.rasterize(polygons, 2, 2, [0, 0, 2])
    line = f.contours([0, 0, 10, 10], 2, 2, 1.0, ND, 5.0, 5.0)
    assert line == [5, 2, 1, 0.5, 0, 0.5, 10, 2, 1, 0, 0, 0]
    assert f.zonal_stats([1, 2, 3, 100], [7] * 4, 2, 2, ND)[:5] == [7, 4, 1, 100, 26.5]
    assert f.apply_binary([1, 2], [3, 4], 2, 1, ND, "subtract") == [-2, -2]


def test_command_line(spark, capsys):
    from gridweft.__main__ import main

    main(["stats"])
    main(["hillshade"])
    out = capsys.readouterr().out
    assert "elevation 75.00 slope 84.89 aspect 333.43" in out
    assert "hillshade 0.00" in out


def test_running_composite(spark, tmp_path):
    from gridweft.streaming.composite import read_layers, running_composite

    rows = [("0", 0, 0, float(v), ts) for v, ts in ((1, "2024-01-01 01:00:00"), (3, "2024-01-01 05:00:00"), (9, "2024-01-03 00:00:00"))]
    spark.createDataFrame(rows, "raster_id string, row int, col int, value double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    query = running_composite(read_layers(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("composites").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["mean"], r["n"]) for r in spark.table("composites").collect()) == [(2.0, 2), (9.0, 1)]


def test_metadata_tables(spark, tmp_path):
    path, grid = str(tmp_path / "m.tif"), G.Grid(40, 30, 0.5, 10.0, 50.0, 0.5, 0.5, 4326)
    S.write_cog(cells(spark, ramp(30, 40)), path, grid, 1, "u16", (16, 16), 1, True, 999.0)
    rows = spark.read.format("cog").option("path", path).option("metadata", "true").load().orderBy("level").collect()
    assert [(r["width"], r["height"], r["sample_format"], r["nodata"], r["compression"], r["masked"]) for r in rows] == [(40, 30, "u16", 999.0, 8, False), (20, 15, "u16", 999.0, 8, False)]
    message = tmp_path / "m.grib2"
    message.write_bytes(grib_bytes() + grib_bytes(0, b"", 9999.0))
    df = spark.read.format("grib2").option("path", str(message))
    assert [r["message"] for r in df.option("metadata", "true").load().collect()] == [0, 1]
    assert df.option("metadata", "false").option("message", 1).load().where("value is not null").count() == 0  # 9999 is no data
    classic = tmp_path / "m.nc"
    classic.write_bytes(netcdf_bytes(1, (("scale_factor", 2.0),)))
    found = {r["variable"]: r for r in spark.read.format("netcdf").option("path", str(classic)).option("metadata", "true").load().collect()}
    assert found["temp"]["shape"] == [2, 2] and found["temp"]["attributes"] == {"scale_factor": "2.0"} and found["precip"]["global_attributes"] == {"title": "made here"}


def test_files_hold_one_raster_and_are_written_by_place(spark, tmp_path):
    one = cells(spark, ramp(20, 3))
    with pytest.raises(G.InvalidInput):
        S.write_geotiff(one.union(one.withColumn("raster_id", F.lit("other"))), str(tmp_path / "x.tif"), G.Grid(3, 20))
    path = str(tmp_path / "y.tif")
    S.write_geotiff(one.where("row <> 7").repartition(5), path, G.Grid(3, 20), rows_a_block=4, transport="gridweft.sources.samples:FileWrite")
    found = back(spark.read.format("geotiff").option("path", path).load(), 20, 3)
    assert np.isnan(found[7]).all() and np.array_equal(np.delete(found, 7, 0), np.delete(ramp(20, 3), 7, 0))
    sink = samples.FileWrite(str(tmp_path / "z"))
    sink.create(b"head")
    sink.write_range(6, b"tail")
    assert (tmp_path / "z").read_bytes() == b"head\0\0tail"


def test_bands(spark):
    both = G.banded([cells(spark, ramp(4, 3)), cells(spark, ramp(4, 3) + 100)], names=["a", None])
    assert G.band_count(both) == 2
    assert {r["band"]: r["name"] for r in G.band_names(both).collect()} == {0: "a", 1: None}
    changed = G.with_band(both, 1, cells(spark, ramp(4, 3) * 2))
    assert changed.columns == both.columns
    got = {(r["row"], r["col"]): r["value"] for r in G.band(changed, 1).collect()}
    assert got == {(r, c): (r * 3 + c) * 2.0 for r in range(4) for c in range(3)}
    assert G.band(both, 5).count() == 0
