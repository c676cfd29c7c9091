import math

import pytest
from pyspark.sql import functions as F

from gridweft.functions import grid as G
from gridweft.operators import algebra, focal, hydro, pyramid, terrain, timeseries, vector, visibility, zonal

ND = -9999.0


def make(spark, values, width, height):
    return G.from_values(spark, values, width, height, ND)


def near(found, wanted, digits=1e-6):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert (a is None and b is None) or abs(a - b) < digits, (found, wanted)


# -- grids --


def test_shapes_and_cells(spark):
    with pytest.raises(G.DimensionMismatch):
        make(spark, [1, 2, 3], 2, 2)
    cells = make(spark, [1, ND, float("nan"), 4], 2, 2)
    assert G.values(cells) == [1.0, None, None, 4.0]
    assert G.values(G.with_cell(cells, 0, 1, 7.0)) == [1.0, 7.0, None, 4.0]
    assert G.values(G.with_cell(cells, 5, 5, 7.0)) == [1.0, None, None, 4.0]
    assert G.cell(cells, 9, 9).count() == 0
    assert G.values(G.blank(spark, G.Grid(2, 1))) == [None, None]
    sparse = cells.where("value is not null")
    assert G.values(G.densify(sparse, G.Grid(2, 2))) == [1.0, None, None, 4.0]


def test_bands_and_stacks(spark):
    a, small = make(spark, [1, 2, 3, 4], 2, 2), G.Grid(3, 3)
    with pytest.raises(G.InvalidInput):
        G.banded([])
    with pytest.raises(G.InvalidInput):
        G.banded([a], names=["x", "y"])
    with pytest.raises(G.IncompatibleRasters):
        G.banded([a, a], [G.Grid(2, 2), small])
    with pytest.raises(G.InvalidInput):
        G.stack([a], [1.0, 2.0])
    assert G.banded([a, a], names=["x", "y"]).select("band", "name").distinct().count() == 2


# -- algebra --


def test_unary(spark):
    near(G.values(algebra.apply_unary(make(spark, [1, 2, 3, 4], 2, 2), "add", 10)), [11, 12, 13, 14])
    near(G.values(algebra.apply_unary(make(spark, [4, 9, 16, 25], 2, 2), "sqrt")), [2, 3, 4, 5])
    near(G.values(algebra.apply_unary(make(spark, [-1, -2, 3, -4], 2, 2), "abs")), [1, 2, 3, 4])
    near(G.values(algebra.apply_unary(make(spark, [1, ND, -3, 4], 2, 2), "sqrt")), [1, None, None, 2])
    logs = G.values(algebra.apply_unary(make(spark, [1, 0, -1, ND], 2, 2), "log"))
    assert logs == [0.0, float("-inf"), None, None]
    with pytest.raises(G.InvalidInput):
        algebra.apply_unary(make(spark, [1], 1, 1), "cube")


def test_binary(spark):
    a, b = make(spark, [5, 1, 8, 3], 2, 2), make(spark, [3, 7, 2, 9], 2, 2)
    near(G.values(algebra.apply_binary(a, b, "min")), [3, 1, 2, 3])
    near(G.values(algebra.apply_binary(a, b, "max")), [5, 7, 8, 9])
    near(G.values(algebra.apply_binary(make(spark, [10, 20, 30, 40], 2, 2), make(spark, [0, 2, 0, 4], 2, 2), "divide")), [None, 10, None, 10])
    with pytest.raises(G.IncompatibleRasters):
        algebra.apply_binary(a, b, "add", G.Grid(3, 3), G.Grid(4, 4))


def test_reclassify(spark):
    bands = [(0, 10, 1), (10, 20, 2), (20, 30, 3)]
    near(G.values(algebra.reclassify(make(spark, [1, 5, 15, 25], 2, 2), bands)), [1, 1, 2, 3])
    near(G.values(algebra.reclassify(make(spark, [10, 30, -1, ND], 2, 2), bands)), [2, None, None, None])
    near(G.values(algebra.reclassify(make(spark, [5], 1, 1), [(0, 10, 1), (0, 10, 2)])), [1])
    assert G.values(algebra.reclassify(make(spark, [5], 1, 1), [])) == [None]


def test_normalized_difference(spark):
    nir, red = make(spark, [0.8, 0.5, ND, 0], 2, 2), make(spark, [0.2, 0.5, 0.1, 0], 2, 2)
    near(G.values(algebra.normalized_difference(nir, red, 0.0)), [0.6, 0, None, None])
    tiny = make(spark, [1e-11], 1, 1)
    assert G.values(algebra.normalized_difference(tiny, make(spark, [0], 1, 1))) == [None]
    assert G.values(algebra.normalized_difference(tiny, make(spark, [0], 1, 1), 0.0)) == [1.0]


# -- terrain --


def test_flat_ground(spark):
    flat = make(spark, [100] * 25, 5, 5)
    assert G.values(terrain.slope(flat, 10.0))[12] == 0
    assert G.values(terrain.aspect(flat, 10.0))[12] is None
    shade = G.values(terrain.hillshade(flat, 10.0))
    near([shade[12]], [180.3122], 1e-3)
    assert shade[0] is None
    near([G.values(terrain.hillshade(flat, 10.0, 315, 30))[12]], [220.8365], 1e-3)
    near([G.values(terrain.hillshade(flat, 10.0, 315, 30, standard=True))[12]], [127.5], 1e-3)


def test_slope_to_the_east(spark):
    dem = make(spark, [c * 10 for _ in range(5) for c in range(5)], 5, 5)
    near([G.values(terrain.slope(dem))[12]], [84.2894], 1e-3)
    near([G.values(terrain.aspect(dem))[12]], [270])
    codes = G.values(terrain.flow_direction(dem))
    near(codes, [0, 16, 16, 16, 16] * 5)
    grid = G.Grid(5, 5)
    near(G.values(hydro.flow_accumulation(terrain.flow_direction(dem), grid)), [4, 3, 2, 1, 0] * 5)
    near(G.values(hydro.watershed(terrain.flow_direction(dem), grid)), [r + 1 for r in range(5) for _ in range(5)])


def test_centre_may_lack_data(spark):
    dem = make(spark, [1, 2, 3, 4, ND, 6, 7, 8, 9], 3, 3)
    assert G.values(terrain.slope(dem))[4] is not None
    assert G.values(terrain.slope(make(spark, [1, 2, 3, ND, 5, 6, 7, 8, 9], 3, 3)))[4] is None


def test_flow_direction(spark):
    assert G.values(terrain.flow_direction(make(spark, [9, 8, 7, 6, 5, 4, 3, 2, 1], 3, 3)))[4] == 4
    assert G.values(terrain.flow_direction(make(spark, [3, 2, 1] * 3, 3, 3)))[4] == 1
    bowl = make(spark, [10] * 4 + [1] + [10] * 4, 3, 3)
    codes = terrain.flow_direction(bowl)
    near(G.values(codes), [2, 4, 8, 1, 0, 16, 128, 64, 32])
    assert G.values(hydro.flow_accumulation(codes, G.Grid(3, 3)))[4] == 8


# -- focal --


def test_focal(spark):
    cells = make(spark, list(range(1, 10)), 3, 3)
    assert G.values(focal.focal_stats(cells, 1, "square", "mean"))[4] == 5
    assert G.values(focal.focal_stats(cells, 1, "square", "mean"))[0] == 3
    assert [G.values(focal.focal_stats(cells, 1, "square", s))[4] for s in ("min", "max", "range")] == [1, 9, 8]
    odd = make(spark, [7] * 4 + [1] + [7] * 4, 3, 3)
    assert [G.values(focal.focal_stats(odd, 1, "square", s))[4] for s in ("median", "majority")] == [7, 7]
    corner = make(spark, [0] * 8 + [100], 3, 3)
    assert G.values(focal.focal_stats(corner, 1, "square", "max"))[4] == 100
    assert G.values(focal.focal_stats(corner, 1, "circle", "max"))[4] == 0
    near(G.values(focal.focal_stats(make(spark, [4, ND, 6], 3, 1), 1, "square", "mean")), [4, None, 6])
    near(G.values(focal.focal_stats(make(spark, [1, 2, 3, 4], 2, 2), 0, "square", "mean")), [1, 2, 3, 4])
    near(G.values(focal.focal_stats(make(spark, [5] * 9, 3, 3), 1, "square", "std")), [0] * 9)
    with pytest.raises(G.InvalidInput):
        focal.focal_stats(cells, 1, "star", "mean")


@pytest.mark.parametrize("shape", focal.SHAPES)
@pytest.mark.parametrize("stat", focal.STATS)
def test_focal_against_brute_force(spark, shape, stat):
    import statistics

    width, height = 6, 5
    data = [((r * 7 + c * 3) % 5) * 1.5 + 1e6 if (r + 2 * c) % 6 else ND for r in range(height) for c in range(width)]
    found = G.values(focal.focal_stats(make(spark, data, width, height), 2, shape, stat))
    steps = focal.window_offsets(2, shape)
    for r in range(height):
        for c in range(width):
            have = [data[(r + a) * width + c + b] for a, b in steps if 0 <= r + a < height and 0 <= c + b < width and data[(r + a) * width + c + b] != ND]
            want = {
                "min": min, "max": max, "sum": sum, "mean": statistics.fmean, "std": statistics.pstdev, "median": statistics.median,
                "range": lambda x: max(x) - min(x), "majority": lambda x: min(v for v in x if x.count(v) == max(map(x.count, x))),
            }[stat](have) if data[r * width + c] != ND else None
            near([found[r * width + c]], [want])


# -- zones and time --


def test_zonal(spark):
    rows = zonal.zonal_stats(make(spark, [10, 20, 30, 40], 2, 2), make(spark, [2, 1, 2, 1], 2, 2)).orderBy("zone").collect()
    assert [(r["zone"], r["mean"]) for r in rows] == [(1, 30), (2, 20)]
    one = zonal.zonal_stats(make(spark, [1, 2, 3, 100], 2, 2), make(spark, [7] * 4, 2, 2)).first()
    assert (one["count"], one["min"], one["max"], one["sum"], one["mean"], one["median"]) == (4, 1, 100, 106, 26.5, 2.5)
    near([one["std"]], [42.4411357])
    gaps = zonal.zonal_stats(make(spark, [10, ND, 30, float("nan")], 2, 2), make(spark, [1, 1, ND, 1], 2, 2)).collect()
    assert [(r["count"], r["sum"]) for r in gaps] == [(1, 10)]
    with pytest.raises(G.DimensionMismatch):
        zonal.zonal_stats(make(spark, [1], 1, 1), make(spark, [1], 1, 1), G.Grid(1, 1), G.Grid(2, 2))


def layers(spark, rows, times=None):
    return G.stack([make(spark, r, len(r), 1) for r in rows], times or list(range(len(rows))))


def test_composites(spark):
    near(G.values(timeseries.composite(layers(spark, [[1, 2, 3], [3, 4, 5], [5, 6, 7]]), "mean")), [3, 4, 5])
    near(G.values(timeseries.composite(layers(spark, [[1, 10], [5, 20], [3, 30]]), "median")), [3, 20])
    pair = layers(spark, [[1, 5], [3, 2]])
    near(G.values(timeseries.composite(pair, "max")) + G.values(timeseries.composite(pair, "min")), [3, 5, 1, 2])
    near(G.values(timeseries.composite(layers(spark, [[ND, 2], [3, ND]]), "mean")), [3, 2])
    with pytest.raises(G.InvalidInput):
        timeseries.composite(pair, "mode")


def test_trend(spark):
    up = timeseries.linear_trend(layers(spark, [[0], [1], [2], [3]])).first()
    near([up["slope"], up["intercept"], up["r_squared"]], [1, 0, 1])
    flat = timeseries.linear_trend(layers(spark, [[5], [5], [5]])).first()
    near([flat["slope"], flat["r_squared"]], [0, 0])
    alone = timeseries.linear_trend(layers(spark, [[5], [ND]])).first()
    assert alone["slope"] is None


def test_change_and_anomaly(spark):
    found = timeseries.change_detection(layers(spark, [[1, 5, 10], [4, 5.5, 10.2]]), 2.0, 2).orderBy("col").collect()
    near([r["magnitude"] for r in found], [3, 0.5, 0.2])
    near([r["changed"] for r in found], [1, 0, 0])
    near(G.values(timeseries.anomaly_zscore(layers(spark, [[1], [2], [3], [4], [10]]), 5)), [6.7082], 1e-3)
    assert G.values(timeseries.anomaly_zscore(layers(spark, [[1], [2]]), 2)) == [None]
    assert G.values(timeseries.anomaly_zscore(layers(spark, [[2], [2], [9]]), 3)) == [0]


def test_phenology(spark):
    season = layers(spark, [[0.1], [0.3], [0.7], [0.9], [0.6], [0.2]], [1, 2, 3, 4, 5, 6])
    found = timeseries.phenology(season, 0.3).first()
    near([found["start_of_season"], found["peak"], found["end_of_season"], found["max_value"]], [3, 4, 6, 0.9])
    assert timeseries.phenology(layers(spark, [[1], [1], [1]])).first()["peak"] is None
    assert timeseries.phenology(layers(spark, [[1], [5], [5]])).first()["peak"] == 2


# -- hydrology --


def test_basins(spark):
    valleys = make(spark, [10, 8, 9, 8, 10, 8, 5, 9, 5, 8, 6, 3, 9, 3, 6, 4, 2, 9, 2, 4, 2, 1, 9, 1, 2], 5, 5)
    codes, grid = terrain.flow_direction(valleys), G.Grid(5, 5)
    near(G.values(hydro.watershed(codes, grid)), [1, 1, 2, 2, 2] * 5)
    flow = G.values(hydro.flow_accumulation(codes, grid))
    assert (flow[21], flow[23]) == (9, 14)
    cone = make(spark, [9, 8, 7, 8, 9, 8, 6, 5, 6, 8, 7, 4, 3, 4, 7, 6, 3, 2, 3, 6, 5, 2, 1, 2, 5], 5, 5)
    codes = terrain.flow_direction(cone)
    flow = hydro.flow_accumulation(codes, grid)
    assert G.values(flow)[22] == 24
    orders = G.values(hydro.stream_order(flow, codes, grid, 1.0))
    near([orders[r * 5 + 2] for r in range(1, 5)], [1, 2, 3, 3])


def test_cycles_are_told(spark):
    with pytest.raises(G.InvalidInput):
        hydro.flow_accumulation(make(spark, [1, 16], 2, 1), G.Grid(2, 1))


@pytest.mark.parametrize("tile", [2, 256])
def test_fill_sinks(spark, tile):
    pit = [10] * 5 + [10, 5, 5, 5, 10] + [10, 5, 1, 5, 10] + [10, 5, 5, 5, 10] + [10, 10, 3, 10, 10]
    found = G.values(hydro.fill_sinks(make(spark, pit, 5, 5), G.Grid(5, 5), tile))
    assert (found[12], found[0], found[22]) == (5, 10, 3)
    slope = [4 - r for r in range(5) for _ in range(5)]
    near(G.values(hydro.fill_sinks(make(spark, slope, 5, 5), G.Grid(5, 5), tile)), slope)
    island = [1, ND, ND, ND, 1, ND, ND, 0, ND, ND, ND, 0, -5, 0, ND, ND, ND, 0, ND, ND, 1, ND, ND, ND, 1]
    near([G.values(hydro.fill_sinks(make(spark, island, 5, 5), G.Grid(5, 5), tile))[12]], [-5])


# -- sight --


def test_viewshed(spark):
    flat = make(spark, [0] * 81, 9, 9)
    near(G.values(visibility.viewshed(flat, G.Grid(9, 9), 4, 4, 2.0, 100.0)), [1] * 81)
    wall = [50.0 if c == 5 else 0.0 for _ in range(5) for c in range(11)]
    seen = G.values(visibility.viewshed(make(spark, wall, 11, 5), G.Grid(11, 5), 2, 0, 2.0, 100.0))
    assert [seen[22 + c] for c in range(11)] == [1.0] * 6 + [0.0] * 5
    high = G.values(visibility.viewshed(make(spark, wall, 11, 5), G.Grid(11, 5), 2, 0, 200.0, 100.0))
    assert [high[22 + c] for c in range(6, 11)] == [0.0, 1.0, 1.0, 1.0, 1.0]
    near_ = G.values(visibility.viewshed(flat, G.Grid(9, 9, 10.0), 4, 4, 2.0, 25.0))
    assert (near_[4 * 9 + 6], near_[4 * 9 + 7]) == (1, None)
    blind = make(spark, [ND] + [0] * 8, 3, 3)
    assert set(G.values(visibility.viewshed(blind, G.Grid(3, 3), 0, 0, 2.0, 9.0))) == {None}
    assert set(G.values(visibility.viewshed(blind, G.Grid(3, 3), 7, 7, 2.0, 9.0))) == {None}


# -- vectors --


def test_contours(spark):
    ramp = make(spark, [r for r in range(5) for _ in range(5)], 5, 5)
    lines = vector.contour_lines(ramp, G.Grid(5, 5), 1.0).collect()
    assert {1.0, 2.0, 3.0} <= {r["level"] for r in lines}
    assert all(len(r["vertices"]) >= 2 for r in lines)
    assert vector.contour_lines(ramp, G.Grid(5, 5), 0.0).count() == 0
    step = make(spark, [0] * 10 + [10] * 10, 5, 4)
    assert 5.0 in {r["level"] for r in vector.contour_lines(step, G.Grid(5, 4), 5.0).collect()}
    peak = make(spark, [0, 0, 0, 0, 9, 0, 0, 0, 0], 3, 3)
    (ring,) = vector.contour_lines(peak, G.Grid(3, 3), 4.0, 1.0).where("level = 5").collect()
    assert len(ring["vertices"]) == 5 and ring["vertices"][0] == ring["vertices"][-1]


def shapes(spark, values, width, height, cell=1.0):
    rows = vector.polygonize(make(spark, values, width, height), G.Grid(width, height, cell)).orderBy("region", "poly").collect()
    return [(r["value"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in rows]


def area(rings):
    return sum(a[0] * b[1] - b[0] * a[1] for ring in rings for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_polygonize(spark):
    block = [5 if 1 <= r <= 2 and 1 <= c <= 2 else 1 for r in range(4) for c in range(4)]
    (_, frame), (_, inner) = shapes(spark, block, 4, 4)
    assert (len(frame), area(frame), len(inner), len(inner[0]), area(inner)) == (2, 12, 1, 5, 4)
    found = shapes(spark, [7, ND, ND, ND, ND, ND, ND, ND, 7], 3, 3)
    assert len(found) == 2
    nan = float("nan")
    assert [area(r) for _, r in shapes(spark, [nan, 2, 2, nan], 4, 1)] == [2]
    assert len(shapes(spark, [2, nan, nan, 2], 2, 2)) == 2
    assert [len(r[0]) for _, r in shapes(spark, [9] * 4, 4, 1)] == [5]
    assert [area(r) for _, r in shapes(spark, [4, 4], 2, 1, 30.0)] == [1800]


def test_regions_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 2)
    snake = [1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    regions = vector.label_regions(make(spark, snake, 5, 5), G.Grid(5, 5)).select("region", "value").distinct().collect()
    assert sorted((r["region"], r["value"]) for r in regions) == [(0, 1.0), (5, 0.0), (16, 0.0)]


def test_rasterize(spark):
    def table(*polygons):
        return spark.createDataFrame([(k, v, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, (v, rings) in enumerate(polygons)], f"poly_ord int, value double, rings array<{vector._POINT}>")

    box, grid = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], G.Grid(4, 4)
    near(G.values(vector.rasterize(table((3.0, [box])), grid, (0, 0, 4, 4))), [3] * 16)
    half = [(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)]
    near(G.values(vector.rasterize(table((3.0, [half])), grid, (0, 0, 4, 4))), [3, 3, None, None] * 4)
    hole = [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    found = G.values(vector.rasterize(table((3.0, [box, hole])), grid, (0, 0, 4, 4)))
    assert (found[5], found[0]) == (None, 3)
    near(G.values(vector.rasterize(table((1.0, [box]), (2.0, [box])), G.Grid(2, 2), (0, 0, 4, 4))), [2] * 4)
    assert set(G.values(vector.rasterize(table((1.0, [box])), G.Grid(2, 2), (0, 0, 0, 4)))) == {None}


def test_vector_round_trip(spark):
    values = [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3]
    found = vector.polygonize(make(spark, values, 4, 4), G.Grid(4, 4))
    flipped = found.select(F.col("region").cast("int").alias("poly_ord"), "value", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), (4 - p["y"]).alias("y")))).alias("rings"))
    near(G.values(vector.rasterize(flipped, G.Grid(4, 4), (0, 0, 4, 4))), values)


# -- pyramids --


def test_pyramids(spark):
    block = make(spark, [1, 2, 5, 6, 3, 4, 7, 8, 1, 2, 5, 6, 3, 4, 7, 8], 4, 4)
    near(G.values(pyramid.overview(block)), [2.5, 6.5, 2.5, 6.5])
    near([G.values(pyramid.overview(make(spark, [1, 2, ND, 4], 2, 2)))[0]], [7 / 3])
    assert pyramid.select_level([0.5, 1, 2, 4], 1.4) == 1
    assert [pyramid.select_level([0.5, 1, 2, 4], t) for t in (0.5, 0.1, 2.0, 100)] == [0, 0, 2, 3]
    tile = G.values(pyramid.extract_tile(block, G.Grid(4, 4), 1, 1, 3, 3))
    assert tile == [8.0] + [None] * 8
    assert math.isclose(G.values(pyramid.window(block, 1, 1, 2, 2))[0], 4)


def test_empty_grids(spark):
    empty = spark.createDataFrame([], G.SCHEMA)
    for result in (terrain.slope(empty), focal.focal_stats(empty, 1), hydro.flow_accumulation(empty, G.Grid(0, 0)), vector.polygonize(empty, G.Grid(0, 0)), vector.contour_lines(empty, G.Grid(0, 0), 1.0), hydro.fill_sinks(empty, G.Grid(0, 0))):
        assert result.count() == 0
