"""Files by df.write, filters that reach readers, arriving files, and operators that hold no whole group."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid, InvalidInput
from gridweft.operators import algebra, focal, zonal
from gridweft.sources import spark as R
from gridweft.sources import tiff
from gridweft.sources.samples import FileRange, format_named
from gridweft.sources.sinks import tiled

from .test_tiles import back, frame


def grid_of(values):
    return Grid(values.shape[1], values.shape[0])


def cells_of(spark, values):
    return frame(spark, values).where("raster_id = 'a'").drop("raster_id")


def read(spark, kind, path, **options):
    R.register(spark)
    return spark.read.format(kind).options(path=str(path), **options).load()


def array(cells, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        if r["value"] is not None:
            out[r["row"], r["col"]] = r["value"]
    return out


def save(cells, kind, path, grid, mode="overwrite", **options):
    R.register(cells.sparkSession)
    cells.write.format(kind).mode(mode).options(path=str(path), width=grid.width, height=grid.height, **options).save()


@pytest.fixture
def values():
    r = np.random.default_rng(2)
    z = np.floor(r.random((37, 41)) * 200)
    z[r.random(z.shape) < 0.1] = np.nan
    return z


@pytest.mark.parametrize("deflate", ["true", "false"])
def test_write_cog(spark, tmp_path, values, deflate):
    path, grid = tmp_path / "a.tif", grid_of(values)
    save(tiled(cells_of(spark, values), grid, (16, 8), 2), "cog", path, grid, tile_width=16, tile_height=8, overviews=2, deflate=deflate, cell_size=2.5, pixel_width=2.5, pixel_height=2.5, epsg=32632)
    np.testing.assert_array_equal(array(read(spark, "cog", path), values.shape), values)
    meta = read(spark, "cog", path, metadata="true").orderBy("level").collect()
    assert [(m["level"], m["width"], m["height"], m["compression"], m["epsg"]) for m in meta] == [(0, 41, 37, 8 if deflate == "true" else 1, 32632), (1, 21, 19, 8 if deflate == "true" else 1, 32632), (2, 11, 10, 8 if deflate == "true" else 1, 32632)]
    with np.errstate(all="ignore"):
        half = np.nanmean(np.pad(values, ((0, 1), (0, 1)), constant_values=np.nan).reshape(19, 2, 21, 2).transpose(0, 2, 1, 3).reshape(19, 21, 4), axis=2)
    np.testing.assert_allclose(array(read(spark, "cog", path, level=1), half.shape), half)
    R.write_cog(cells_of(spark, values).withColumn("raster_id", F.lit("x")), str(tmp_path / "b.tif"), Grid(41, 37, 2.5, 0, 0, 2.5, 2.5, 32632), tile=(16, 8), overviews=2, deflate=deflate == "true")
    assert (tmp_path / "a.tif").stat().st_size == (tmp_path / "b.tif").stat().st_size
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]


def test_write_modes(spark, tmp_path, values):
    path, grid = tmp_path / "a.tif", grid_of(values)
    save(tiled(cells_of(spark, values), grid), "geotiff", path, grid, "append")
    with pytest.raises(Exception, match="exists"):
        save(tiled(cells_of(spark, values * 2), grid), "geotiff", path, grid, "append")
    np.testing.assert_array_equal(array(read(spark, "geotiff", path), values.shape), values)
    save(tiled(cells_of(spark, values * 2), grid), "geotiff", path, grid)
    np.testing.assert_array_equal(array(read(spark, "geotiff", path), values.shape), values * 2)


@pytest.mark.parametrize("deflate", ["true", "false"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, values, deflate):
    path, grid = tmp_path / "a.tif", grid_of(values)
    good = tiled(cells_of(spark, values), grid, (16, 16))
    save(good, "cog", path, grid, tile_width=16, tile_height=16)
    before = path.read_bytes()
    outside = good.withColumn("row", F.when((F.col("row") == 30) & (F.col("col") == 40), 99).otherwise(F.col("row")))
    with pytest.raises(Exception, match="outside the grid"):
        save(outside, "cog", path, grid, tile_width=16, tile_height=16, deflate=deflate)
    with pytest.raises(Exception, match="tiled"):
        save(good.repartition(7), "cog", path, grid, tile_width=16, tile_height=16, deflate=deflate)
    with pytest.raises(Exception, match="several rasters"):
        save(good.withColumn("raster_id", F.col("row").cast("string")), "cog", path, grid, tile_width=16, tile_height=16, deflate=deflate)
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["a.tif"]


def test_absent_tiles_and_bands(spark, tmp_path):
    grid = Grid(20, 600)
    cells = spark.createDataFrame([(0, 3, 4, 7.0), (1, 3, 4, 8.0), (1, 599, 19, 9.0)], "band int, row int, col int, value double")
    save(tiled(cells, grid), "geotiff", tmp_path / "a.tif", grid, bands=2, sample_format="i16")
    found = read(spark, "geotiff", tmp_path / "a.tif").where("value is not null").select("band", "row", "col", "value")
    assert sorted(tuple(r) for r in found.collect()) == [(0, 3, 4, 7.0), (1, 3, 4, 8.0), (1, 599, 19, 9.0)]
    save(tiled(cells, grid, (16, 16)), "cog", tmp_path / "b.tif", grid, bands=2, sample_format="f32", tile_width=16, tile_height=16, deflate="true", nodata="-1")
    found = read(spark, "cog", tmp_path / "b.tif").where("value is not null").select("band", "row", "col", "value")
    assert sorted(tuple(r) for r in found.collect()) == [(0, 3, 4, 7.0), (1, 3, 4, 8.0), (1, 599, 19, 9.0)]


def test_functions_leave_no_half_files(spark, tmp_path, values):
    path = str(tmp_path / "a.tif")
    R.write_geotiff(frame(spark, values).where("raster_id = 'a'"), path, grid_of(values))
    before = open(path, "rb").read()
    with pytest.raises(Exception):
        R.write_geotiff(frame(spark, values).where("raster_id = 'a'").withColumn("col", F.col("col") + 5), path, grid_of(values))
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["a.tif"]


@pytest.mark.parametrize(("kind", "predictor"), [("u8", 2), ("i16", 2), ("u32", 2), ("f32", 3), ("f64", 3)])
def test_predictors(spark, tmp_path, values, kind, predictor):
    fmt, tile = format_named(kind), (8, 4)
    raw = np.random.default_rng(1).integers(0, 256, 8 * 4 * 3 * fmt.bytes, dtype=np.uint8).tobytes()
    level = tiff.Level(tiff.Directory({}, 0), Grid(8, 4), fmt, 3, tile, 1, predictor, None)
    np.testing.assert_array_equal(tiff.decode_tile(level, tiff.predicted(raw, predictor, fmt, tile, 3)), fmt.decode(raw).reshape(4, 8, 3))
    nodata = 255.0 if kind == "u8" else -1.0 if kind != "u32" else 9.0
    whole = np.where(values == nodata, np.nan, values)
    R.write_cog(frame(spark, whole).where("raster_id = 'a'"), str(tmp_path / "p.tif"), grid_of(values), 1, kind, (16, 16), 1, True, nodata, predictor=predictor, sparse=True)
    np.testing.assert_array_equal(array(read(spark, "cog", tmp_path / "p.tif"), values.shape), whole)
    with pytest.raises(InvalidInput):
        tiff.check_predictor(fmt, 5 - predictor)


def test_sparse_tiles_have_no_bytes(spark, tmp_path):
    z = np.full((40, 40), np.nan)
    z[20:, 25:] = 3.0
    R.write_cog(frame(spark, z).where("raster_id = 'a'"), str(tmp_path / "s.tif"), grid_of(z), 1, "f32", (16, 16), 0, False, -1.0, sparse=True)
    (level,) = tiff.open_levels(FileRange(str(tmp_path / "s.tif")))
    assert [k for k in range(9) if level.span(k) != (0, 0)] == [4, 5, 7, 8]
    np.testing.assert_array_equal(array(read(spark, "cog", tmp_path / "s.tif"), z.shape), z)


def test_filters_reach_the_reader(spark, tmp_path, values):
    path = tmp_path / "a.tif"
    R.write_cog(frame(spark, values).where("raster_id = 'a'"), str(path), grid_of(values), tile=(8, 8))
    cells = read(spark, "cog", path, tile_bytes=1)
    assert cells.rdd.getNumPartitions() == 30
    box = cells.where((F.col("row") >= 10) & (F.col("row") < 16) & (F.col("col") == 9))
    assert box.rdd.getNumPartitions() == 1
    assert {(r["row"], r["col"]) for r in box.collect()} == {(r, 9) for r in range(10, 16)}
    other = cells.where("raster_id = 'other.tif'")
    assert other.rdd.getNumPartitions() == 1 and other.count() == 0
    assert read(spark, "cog", path, push="false", row_min=500).count() == 0
    assert cells.where("raster_id in ('a.tif', 'b')").count() == values.size
    assert cells.where("band = 1").count() == 0 and cells.where("band = 0").count() == values.size
    assert read(spark, "cog", path, tile_bytes=1, push="false").where("row = 3").rdd.getNumPartitions() == 30
    assert read(spark, "cog", path, band=0).where("band = 1").count() == 0


def test_arriving_files(spark, tmp_path, values):
    """Files named between batches come once each; a stream that starts again goes on where it was."""
    folder = tmp_path / "in"
    folder.mkdir()
    R.register(spark)

    def put(name, factor):
        R.write_geotiff(frame(spark, values * factor).where("raster_id = 'a'"), str(folder / name), grid_of(values))

    def run():
        query = spark.readStream.format("geotiff").option("path", str(folder)).option("max_files", 2).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return {r["raster_id"]: (r["n"], r["s"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()}

    for k in range(3):
        put(f"{k}.tif", k + 1)
    total = np.nansum(values)
    assert run() == {f"{k}.tif": (values.size, total * (k + 1)) for k in range(3)}
    put("late.tif", 9)
    assert run() == {f"{k}.tif": (values.size, total * (k + 1)) for k in range(3)} | {"late.tif": (values.size, total * 9)}


# -- groups that no task holds --


@pytest.mark.parametrize("hot", [3, 10**9])
def test_medians_by_counts(spark, hot):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(0, 1, 500), np.full(200, 0.25), [1e300, -1e300, 5e-324, 0.0]])
    rows = [("a", k, 0, float(x)) for k, x in enumerate(v)] + [("b", k, 0, float(k // 3)) for k in range(11)] + [("c", 0, 0, 4.0), ("c", 1, 0, None)]
    values = spark.createDataFrame(rows, "raster_id string, row int, col int, value double")
    zones = values.withColumn("value", F.when(F.col("raster_id") == "a", F.col("row") % 2).otherwise(0).cast("double"))
    found = {(x["raster_id"], x["zone"]): (x["count"], x["median"]) for x in zonal.zonal_stats(values, zones, hot_cells=hot).collect()}
    b = [float(k // 3) for k in range(11)]
    assert found == {("a", 0.0): (len(v[::2]), np.median(v[::2])), ("a", 1.0): (len(v[1::2]), np.median(v[1::2])), ("b", 0.0): (11, np.median(b)), ("c", 0.0): (1, 4.0)}


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_class_tables(spark, bins):
    r = np.random.default_rng(6)
    lo = np.round(r.normal(0, 20, 60), 1)
    classes = [(int(k), float(x), float(x + w), float(k * 10)) for k, (x, w) in enumerate(zip(lo, np.round(r.exponential(3, 60), 1), strict=True))]
    classes += [(70, None, -30.0, -1.0), (71, 40.0, None, -2.0), (72, 3.0, 3.0, -3.0), (73, 5.0, 1.0, -4.0), (None, -1000.0, 1000.0, -5.0)]
    z = np.concatenate([np.round(r.normal(0, 25, 300), 1), lo, [5000.0, -5000.0, np.nan]])[None]
    table = spark.createDataFrame(classes, "ord int, min double, max double, new double")
    inf = float("inf")
    wanted = [next((n for _, a, b, n in classes if (-inf if a is None else a) <= x < (inf if b is None else b)), np.nan) for x in z[0]]
    cells = frame(spark, z)
    np.testing.assert_array_equal(back(algebra.reclassify_table(cells, table, bins), z.shape), [wanted])
    simple = [(float(a), float(b), float(n)) for _, a, b, n in classes[:60]]
    np.testing.assert_array_equal(back(algebra.reclassify(cells, simple), z.shape), back(algebra.reclassify_table(cells, table.where("ord < 60"), bins), z.shape))
    assert np.isnan(back(algebra.reclassify_table(cells, table.limit(0)), z.shape)).all()


@pytest.mark.parametrize(("shape", "radius", "tile"), [("square", 2, 5), ("circle", 6, 8), ("square", 9, 256), ("circle", 0, 4)])
def test_ordered_windows(spark, shape, radius, tile):
    r = np.random.default_rng(8)
    z = np.floor(r.random((19, 23)) * 6)
    z[r.random(z.shape) < 0.2] = np.nan
    z[3, 3] = np.inf
    cells = frame(spark, z).withColumn("note", F.concat("raster_id", F.lit("!")))
    for stat in ("median", "majority"):
        wanted = np.full(z.shape, np.nan)
        for (y, x), v in np.ndenumerate(z):
            if not np.isnan(v):
                near = sorted(z[y + a, x + b] for a, b in focal.window_offsets(radius, shape) if 0 <= y + a < z.shape[0] and 0 <= x + b < z.shape[1] and not np.isnan(z[y + a, x + b]))
                wanted[y, x] = np.median(near) if stat == "median" else max(sorted(set(near)), key=near.count)
        found = focal.focal_stats(cells, radius, shape, stat, tile)
        assert found.columns == cells.columns and found.where("note <> concat(raster_id, '!')").count() == 0
        np.testing.assert_array_equal(back(found, z.shape), wanted)


@pytest.mark.parametrize("deflate", [True, False])
def test_masks(spark, tmp_path, values, deflate):
    """Cells without data by a mask; zeros and the value that would be nodata are data; a mask is read with its tile alone."""
    z = np.where(values < 20, 0.0, values)
    R.write_cog(frame(spark, z).where("raster_id = 'a'"), str(tmp_path / "m.tif"), grid_of(z), 1, "u8", (16, 16), 1, deflate, masked=True)
    np.testing.assert_array_equal(array(read(spark, "cog", tmp_path / "m.tif"), z.shape), z)
    assert [r["masked"] for r in read(spark, "cog", tmp_path / "m.tif", metadata="true").collect()] == [True, True]
    levels = tiff.open_levels(FileRange(str(tmp_path / "m.tif")))
    assert levels[0].nodata is None and levels[1].mask.grid.width == levels[1].grid.width
    asked = []

    class Counting(FileRange):
        def read_range(self, offset, length):
            asked.append((offset, length))
            return super().read_range(offset, length)

    tiff.read_window(Counting(str(tmp_path / "m.tif")), levels[0], 17, 2, 4, 4)
    assert sorted(asked) == sorted([levels[0].span(1), levels[0].mask.span(1)])


def test_ranges_over_http(spark, tmp_path, values):
    """Tiles of a box come in a few requests, each of a range; without ranges the server's whole answer will do."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from gridweft.functions.grid import FormatError
    from gridweft.sources.samples import HttpRange, coalesced

    R.write_cog(frame(spark, values).where("raster_id = 'a'"), str(tmp_path / "h.tif"), grid_of(values), tile=(8, 8), deflate=True)
    data, asked = (tmp_path / "h.tif").read_bytes(), []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            if self.path == "/none.tif":
                return self.send_error(404)
            given, body = self.headers.get("Range"), data
            asked.append(given)
            if given and self.path != "/whole.tif":
                low, high = map(int, given.removeprefix("bytes=").split("-"))
                body = data[low : high + 1]
            self.send_response(206 if body is not data else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}/h.tif"
        source = HttpRange(at)
        assert source.size() == len(data) and source.read_range(10, 7) == data[10:17] and source.read_range(5, 0) == b""
        asked.clear()
        assert source.read_ranges([(90, 10), (0, 5), (95, 20)]) == [data[90:100], data[0:5], data[95:115]] and asked == ["bytes=0-114"]
        with pytest.raises(FormatError):
            source.read_range(len(data) - 3, 9)
        with pytest.raises(FormatError):
            HttpRange(at.replace("h.tif", "none.tif")).read_range(0, 4)
        assert HttpRange(at.replace("h.tif", "whole.tif")).read_range(10, 7) == data[10:17]
        asked.clear()
        found = read(spark, "cog", at, transport="gridweft.sources.samples:HttpRange").where("row < 16")
        box = np.full(values.shape, np.nan)
        box[:16] = values[:16]
        np.testing.assert_array_equal(array(found, values.shape), box)
        assert sum(int(b) - int(a) for a, b in (r.removeprefix("bytes=").split("-") for r in asked)) < len(data)
    finally:
        server.shutdown()
    assert coalesced([(0, 4), (4, 4), (20, 4), (9, 3)], 1) == [(0, 12, [0, 1, 3]), (20, 4, [2])]
