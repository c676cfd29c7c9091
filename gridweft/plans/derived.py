"""Registered queries of grid constructors, flat arrays, named functions and joined vectors.

What depends on an order of tracing is compared by figures that do not: counts, lengths, areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions import flat
from gridweft.functions import grid as G
from gridweft.functions.rounds import cut
from gridweft.operators import algebra, focal, hydro, pyramid, terrain, vector, zonal
from gridweft.plans import surfaces as S

QUERIES = {}
ORACLES = {}
ND = -9999.0


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _cut(column: str):
    return (F.floor(F.col(column) * 1e6 + 0.5) / 1e6).alias(column)


# -- grids --

_SQL_FRAME = "SELECT r::INT AS row, c::INT AS col FROM generate_series(0, 15) AS a(r), generate_series(0, 15) AS b(c)"


@_query(f"SELECT row, col, CASE WHEN row * 16 + col NOT IN (3, 77) THEN (row * 16 + col)::DOUBLE END AS value FROM ({_SQL_FRAME})")
def grid_from_values(spark: SparkSession, d: str) -> DataFrame:
    """Row-major values; the sentinel and NaN are no data."""
    data = [float(k) for k in range(256)]
    data[3], data[77] = ND, float("nan")
    return G.from_values(spark, data, 16, 16, ND).select("row", "col", "value")


@_query(f"SELECT row, col, NULL::DOUBLE AS value FROM ({_SQL_FRAME})")
def grid_blank(spark: SparkSession, d: str) -> DataFrame:
    return G.blank(spark, S.SALES).select("row", "col", "value")


@_query(f"SELECT row, col, CASE WHEN row = 4 AND col = 5 THEN 1.5 WHEN row = 6 AND col = 7 THEN NULL ELSE value END AS value FROM ({S.SQL_HOLES})")
def grid_with_cells(spark: SparkSession, d: str) -> DataFrame:
    """Two cells changed; a place outside the grid changes nothing."""
    cells = G.with_cell(G.with_cell(S.holes(spark, d), 4, 5, 1.5), 6, 7, None)
    return G.with_cell(cells, 99, 0, 8.0).select("row", "col", "value")


@_query(f"SELECT row, col, value FROM ({S.SQL_HOLES}) WHERE row = 9 AND col = 2")
def grid_cell(spark: SparkSession, d: str) -> DataFrame:
    return G.cell(S.holes(spark, d), 9, 2).select("row", "col", "value")


@_query(f"SELECT f.row, f.col, g.value FROM ({_SQL_FRAME}) f LEFT JOIN (SELECT * FROM ({S.SQL_SALES}) WHERE col > 3) g ON g.row = f.row AND g.col = f.col")
def grid_densify(spark: SparkSession, d: str) -> DataFrame:
    return G.densify(S.sales(spark, d).where(F.col("col") > 3), S.SALES).select("row", "col", "value")


@_query(f"SELECT 'tax' AS name, 0 AS band, sum(tax) AS total, 2 AS bands FROM ({S.SQL_BANDS}) UNION ALL SELECT 'discount', 1, sum(discount) * 2, 2 FROM ({S.SQL_BANDS})")
def grid_bands(spark: SparkSession, d: str) -> DataFrame:
    """Names, number and values of bands, the second one replaced by its double."""
    cells = G.banded(list(S.bands(spark, d)), names=["tax", "discount"])
    double = algebra.apply_unary(G.band(cells, 1), "multiply", 2.0)
    cells = G.with_band(cells, 1, double)
    sums = cells.groupBy("band").agg(F.sum("value").alias("total"))
    return sums.join(G.band_names(cells), "band").withColumn("bands", F.lit(G.band_count(cells))).select("name", "band", "total", "bands")


@_query(f"SELECT 0 AS t_idx, 3.0::DOUBLE AS t, count(value) AS cells FROM ({S.SQL_SALES}) UNION ALL SELECT 1, 1.0, count(value) FROM ({S.SQL_HOLES})")
def grid_stack(spark: SparkSession, d: str) -> DataFrame:
    """Layers stay in the order given, whatever their times."""
    return G.stack([S.sales(spark, d), S.holes(spark, d)], [3.0, 1.0]).groupBy("t_idx", "t").agg(F.count("value").alias("cells"))


@_query("SELECT * FROM (VALUES (1.0::DOUBLE, 0), (9.0, 2), (10.0, 2), (50.0, 3), (0.5, 0)) AS v(target, level)")
def select_level(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, pyramid.select_level([1.0, 3.0, 9.0, 27.0], t)) for t in (1.0, 9.0, 10.0, 50.0, 0.5)]
    return spark.createDataFrame(rows, "target double, level int")


# -- named functions of small grids as lists --


def _list(cells: DataFrame) -> list[float]:
    return [ND if v is None else v for v in G.values(cells)]


def _grid(spark: SparkSession, values: list) -> DataFrame:
    return G.from_values(spark, values, 16, 16).select("row", "col", _cut("value"))


def _function(name: str, call, same) -> None:
    """A query fn_<name> of RasterFunctions; its oracle is the SQL of the query `same` over the same grid."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return _grid(spark, call(flat.RasterFunctions(spark), _list(S.holes(spark, d)), _list(S.sales(spark, d))))

    QUERIES[f"fn_{name}"], ORACLES[f"fn_{name}"] = query, same


def register_functions(oracles: dict[str, str], cut) -> None:
    """Queries fn_* whose oracle SQL is that of the operators' queries."""
    holes = S.SQL_HOLES
    _function("slope", lambda f, a, b: f.slope(a, 16, 16, 10.0, ND), oracles["slope_holes"])
    _function("fill_sinks", lambda f, a, b: f.fill_sinks(a, 16, 16, 10.0, ND), oracles["fill_sinks"])
    _function("focal_mean", lambda f, a, b: f.focal_stats(a, 16, 16, ND, 2, "circle", "mean"), oracles["focal_mean_circle"])
    _function("focal_range", lambda f, a, b: f.focal_stats(a, 16, 16, ND, 2, "square", "range"), oracles["focal_range_square"])
    _function("unary", lambda f, a, b: f.apply_unary(a, 16, 16, ND, "multiply", 2.5), oracles["map_multiply"])
    _function("binary", lambda f, a, b: f.apply_binary(a, b, 16, 16, ND, "divide"), f"SELECT a.row, a.col, {cut('CASE WHEN b.value <> 0 THEN a.value / b.value END', 'value')} FROM ({holes}) a JOIN ({S.SQL_SALES}) b ON a.row = b.row AND a.col = b.col")
    _function("normalized_difference", lambda f, a, b: f.normalized_difference(a, [x * 3 for x in b], 16, 16, ND), f"SELECT a.row, a.col, {cut('CASE WHEN a.value + b.value * 3 <> 0 THEN (a.value - b.value * 3) / (a.value + b.value * 3) END', 'value')} FROM ({holes}) a JOIN ({S.SQL_SALES}) b ON a.row = b.row AND a.col = b.col")
    _function("reclassify", lambda f, a, b: f.reclassify(a, 16, 16, ND, [0, 700, 1, 700, 1e9, 2]), f"SELECT row, col, CASE WHEN value < 700 THEN 1.0::DOUBLE WHEN value >= 700 THEN 2.0::DOUBLE END AS value FROM ({holes})")
    near = oracles["slope_holes"].split(" SELECT row, col, ")[0]
    _function("aspect", lambda f, a, b: f.aspect(a, 16, 16, 10.0, ND), near + " SELECT row, col, " + oracles["aspect"].split(" SELECT row, col, ")[-1])
    _function("hillshade", lambda f, a, b: f.hillshade(a, 16, 16, 10.0, ND, 315.0, 45.0), near + " SELECT row, col, " + oracles["hillshade"].split(" SELECT row, col, ")[-1])


@_query(f"SELECT (row % 4)::DOUBLE AS zone, count(value)::DOUBLE AS n, min(value) AS low, max(value) AS high, sum(value) AS total FROM ({S.SQL_HOLES}) WHERE value IS NOT NULL GROUP BY 1")
def fn_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    found = flat.RasterFunctions(spark).zonal_stats(_list(S.holes(spark, d)), [float(k // 16 % 4) for k in range(256)], 16, 16, ND)
    rows = [tuple(found[k : k + 8]) for k in range(0, len(found), 8)]
    return spark.createDataFrame([(z, n, lo, hi, total) for z, n, lo, hi, _, total, _, _ in rows], "zone double, n double, low double, high double, total double")


@_query(f"SELECT row, col, CASE WHEN row BETWEEN 2 AND 8 AND col BETWEEN 3 AND 9 THEN 5.0::DOUBLE END AS value FROM ({_SQL_FRAME})")
def fn_rasterize(spark: SparkSession, d: str) -> DataFrame:
    """A square in flat form: columns 3 to 9, rows 2 to 8 of a box of 16 by 16."""
    values = flat.RasterFunctions(spark).rasterize([5, 1, 5, 3, 7, 3, 14, 10, 14, 10, 7, 3, 7], 16, 16, [0, 0, 16, 16])
    return _grid(spark, values)


@_query(f"SELECT row, col, {ND}::DOUBLE + 9999 + value AS value FROM ({S.SQL_SALES})")
def fn_write_cog(spark: SparkSession, d: str) -> DataFrame:
    from gridweft.functions.rounds import shared_folder
    from gridweft.sources.spark import register

    path = f"{shared_folder(spark)}/fn.tif"
    flat.RasterFunctions(spark).write_cog([_list(S.sales(spark, d))], 16, 16, path, ND, tile_size=8, overviews=1, deflate=True)
    register(spark)
    return spark.read.format("cog").option("path", path).load().select("row", "col", "value")


# -- joined vectors --

#: Levels at halves, which whole numbers never equal, so each crossing has two segments at most.
_STEP, _BASE = 40.0, 0.5


def _tile(grid: G.Grid) -> int:
    """A quarter of the grid's side, so that grids of the smallest tables have several tiles, and no more than by default."""
    return min(hydro.TILE, max(8, -(-grid.width // 4)))



def _figures(lines: DataFrame) -> DataFrame:
    sides = F.transform(F.sequence(F.lit(1), F.size("vertices") - 1), lambda k: F.hypot(F.element_at("vertices", k)["x"] - F.element_at("vertices", k + 1)["x"], F.element_at("vertices", k)["y"] - F.element_at("vertices", k + 1)["y"]))
    first, last = F.element_at("vertices", 1), F.element_at("vertices", -1)
    closed = ((F.abs(first["x"] - last["x"]) < 1e-6) & (F.abs(first["y"] - last["y"]) < 1e-6)).cast("long")
    lines = lines.withColumn("length", F.aggregate(sides, F.lit(0.0), lambda a, b: a + b)).withColumn("closed", closed)
    return lines.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.sum("closed").alias("closed"), F.sum(F.size("vertices")).alias("vertices"), (F.floor(F.sum("length") * 1e3 + 0.5) / 1e3).alias("length"))


def contour_sql(segments: str) -> str:
    """Lines of segments (level, x1, y1, x2, y2) by their shared ends, which are rounded to millionths."""
    key = lambda x, y: f"(round({x} * 1e6)::BIGINT, round({y} * 1e6)::BIGINT)"
    return (
        f"WITH RECURSIVE sg AS MATERIALIZED (SELECT row_number() OVER () AS id, level, {key('x1', 'y1')} AS a, {key('x2', 'y2')} AS b, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS n FROM ({segments})), "
        "ends AS MATERIALIZED (SELECT id, level, a AS p FROM sg UNION ALL SELECT id, level, b FROM sg), "
        "near AS MATERIALIZED (SELECT e.id AS a, f.id AS b FROM ends e JOIN ends f ON e.level = f.level AND e.p = f.p), "
        "reach(id, other) AS (SELECT id, id FROM sg UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.other), "
        "line AS (SELECT id, min(other) AS line FROM reach GROUP BY id), "
        "tips AS (SELECT level, line, count(*) AS tips FROM (SELECT e.level, l.line, e.p FROM ends e JOIN line l ON l.id = e.id GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL), "
        "lines AS (SELECT s.level, l.line, count(*) AS segments, sum(s.n) AS n FROM sg s JOIN line l ON l.id = s.id GROUP BY ALL) "
        "SELECT ls.level, count(*) AS lines, count(*) FILTER (t.tips IS NULL) AS closed, (sum(segments) + count(*))::BIGINT AS vertices, floor(sum(n) * 1e3 + 0.5) / 1e3 AS length FROM lines ls LEFT JOIN tips t ON t.level = ls.level AND t.line = ls.line GROUP BY ls.level"
    )


def contour_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of each level: lines, closed ones, vertices and length."""
    return _figures(vector.contour_lines(S.holes(spark, d).withColumn("value", F.col("value") % 400), S.SALES, _STEP, _BASE))


def flat_contours(spark: SparkSession, d: str) -> DataFrame:
    """Level, number of vertices and of coordinates of each line in flat form, by level."""
    lines = flat.flat_contours(vector.contour_lines(S.holes(spark, d).withColumn("value", F.col("value") % 400), S.SALES, _STEP, _BASE))
    return lines.groupBy(F.element_at("flat", 1).alias("level")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.element_at("flat", 2)).cast("long").alias("vertices"), F.sum((F.size("flat") - 2) / 2).cast("long").alias("pairs"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return S.holes(spark, d).withColumn("value", F.floor(F.col("value") / 60).cast("double"))


#: Regions of equal classes; of each corner of the grid which of the four cells around it are a region's.
_SQL_REGIONS = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT row * 16 + col AS id, row, col, floor(value / 60) AS value FROM ({S.SQL_HOLES}) WHERE value IS NOT NULL),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach(id, other) AS (SELECT id, id FROM g UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
l AS (SELECT id, min(other) AS region FROM reach GROUP BY id),
c AS (SELECT l.region, g.value, g.row + dr AS y, g.col + dc AS x, sum(CASE WHEN dr = dc THEN 1 ELSE 10 END) AS kind FROM l JOIN g ON g.id = l.id, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(dr, dc) GROUP BY ALL),
k AS (SELECT region, value, count(*) FILTER (kind IN (1, 10)) AS q1, count(*) FILTER (kind IN (12, 21)) AS q3, count(*) FILTER (kind IN (2, 20)) AS qd FROM c GROUP BY ALL),
n AS (SELECT region, count(*) AS cells FROM l GROUP BY region)"""


def _polygon_figures(polygons: DataFrame) -> DataFrame:
    """Of each region: rings, corners and area, holes being traced the other way round."""
    ring = F.explode("rings").alias("ring")
    rings = polygons.select("region", "value", "poly", ring)
    twice = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, k: s + F.element_at("ring", k)["x"] * F.element_at("ring", k + 1)["y"] - F.element_at("ring", k + 1)["x"] * F.element_at("ring", k)["y"])
    return rings.groupBy("region", "value").agg(F.count(F.lit(1)).alias("rings"), F.sum(F.size("ring") - 1).alias("corners"), F.sum(twice / 2).alias("area"))


@_query(f"{_SQL_REGIONS} SELECT k.region::BIGINT AS region, k.value::DOUBLE AS value, (q1 + q3 + 2 * qd)::BIGINT AS corners, (cells * 100)::DOUBLE AS area FROM k JOIN n ON n.region = k.region")
def polygonize_rings(spark: SparkSession, d: str) -> DataFrame:
    """Corners and area of each region's rings."""
    return _polygon_figures(vector.polygonize(_classes(spark, d), S.SALES)).select("region", "value", "corners", "area")


@_query(f"{_SQL_REGIONS} SELECT k.value::DOUBLE AS value, sum(cells)::DOUBLE AS cells, (sum(q1 + q3 + 2 * qd))::BIGINT AS corners FROM k JOIN n ON n.region = k.region GROUP BY k.value")
def polygons_back_to_cells(spark: SparkSession, d: str) -> DataFrame:
    """Polygons in flat form, read again and rasterised: cells and corners of each value."""
    found = flat.flat_polygons(vector.polygonize(_classes(spark, d), S.SALES))
    shapes = [p for r in found.select("flat").collect() for p in flat.read_flat_polygons(r["flat"])]  # of a grid of 256 cells
    corners = spark.createDataFrame([(v, sum(len(r) - 1 for r in rings)) for v, rings in shapes], "value double, corners long").groupBy("value").agg(F.sum("corners").alias("corners"))
    rows = [(k, v, [[{"x": x, "y": 160.0 - y} for x, y in r] for r in rings]) for k, (v, rings) in enumerate(shapes)]
    table = spark.createDataFrame(rows, f"poly_ord int, value double, rings {'array<' + vector._POINT + '>'}")
    cells = vector.rasterize(table, S.SALES, (0.0, 0.0, 160.0, 160.0)).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("cells"))
    return cells.join(corners, "value").select("value", "cells", "corners")


# -- larger grids: as many cells as there are line items --

_WIDE = {"slope": lambda c: terrain.slope(c, 10.0), "hillshade": lambda c: terrain.hillshade(c, 10.0), "aspect": lambda c: terrain.aspect(c, 10.0), "flow_direction": lambda c: terrain.flow_direction(c, 10.0)}


def register_wide(oracles: dict[str, str], near: str) -> None:
    """Queries wide_* over plane(), with the SQL of the operators' queries over its cells."""
    for name, operator in _WIDE.items():
        QUERIES[f"wide_{name}"] = lambda spark, d, f=operator: f(S.plane(spark, d)).select("row", "col", _cut("value"))
    steep = oracles["slope_holes"].replace(f"g AS ({S.SQL_HOLES})", f"g AS ({S.SQL_PLANE})")
    ORACLES["wide_slope"] = steep
    for name in ("aspect", "hillshade"):
        ORACLES[f"wide_{name}"] = steep.split(" SELECT row, col, floor(")[0] + " SELECT row, col, " + oracles[name].split(" SELECT row, col, ")[-1]
    ORACLES["wide_flow_direction"] = oracles["flow_direction"].replace(f"g AS ({S.SQL_HOLES})", f"g AS ({S.SQL_PLANE})")
    near_cells = "o(dr, dc) AS (SELECT r, c FROM range(-1, 2) AS a(r), range(-1, 2) AS b(c)), w AS (SELECT g.row + dr AS row, g.col + dc AS col, value FROM g, o), h AS (SELECT g.row, g.col, w.value AS value FROM g JOIN w ON g.row = w.row AND g.col = w.col)"
    ends = {
        "mean": "SELECT row, col, floor(avg(value) * 1e6 + 0.5) / 1e6 AS value FROM h GROUP BY row, col",
        "max": "SELECT row, col, max(value) AS value FROM h GROUP BY row, col",
        "majority": "SELECT row, col, value FROM (SELECT row, col, value, count(*) AS n FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1",
    }
    for stat, end in ends.items():
        ORACLES[f"wide_focal_{stat}"] = f"WITH g AS MATERIALIZED ({S.SQL_PLANE}), {near_cells} {end}"
        QUERIES[f"wide_focal_{stat}"] = lambda spark, d, s=stat: focal.focal_stats(S.plane(spark, d), 1, "square", s).select("row", "col", _cut("value"))


@_query(f"SELECT zone, count(*) AS count, min(value) AS min, max(value) AS max, sum(value) AS sum, median(value) AS median FROM (SELECT ((row // 16) * 1000 + col // 16)::DOUBLE AS zone, value FROM ({S.SQL_PLANE})) GROUP BY zone")
def wide_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Zones of 16 x 16 cells."""
    cells = S.plane(spark, d)
    zones = cells.withColumn("value", (F.floor(F.col("row") / 16) * 1000 + F.floor(F.col("col") / 16)).cast("double"))
    return zonal.zonal_stats(cells, zones).select("zone", "count", "min", "max", "sum", "median")


def wide_contour_lines(spark: SparkSession, d: str) -> DataFrame:
    """The figures of contour_lines over plane(), from pieces of lines: no line is put together."""
    grid = S.plane_grid(spark, d)
    pieces = vector.contour_chains(S.plane(spark, d), grid, 80.0, 40.5, _tile(grid))
    sides = F.transform(F.sequence(F.lit(1), F.size("vertices") - 1), lambda k: F.hypot(F.element_at("vertices", k)["x"] - F.element_at("vertices", k + 1)["x"], F.element_at("vertices", k)["y"] - F.element_at("vertices", k + 1)["y"]))
    pieces = pieces.withColumn("length", F.aggregate(sides, F.lit(0.0), lambda a, b: a + b))
    lines = pieces.groupBy("level", "line_id").agg(F.max(F.col("closed").cast("long")).alias("closed"), F.sum(F.size("vertices") - 1).alias("sides"), F.sum("length").alias("length"))
    return lines.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.sum("closed").alias("closed"), F.sum(F.col("sides") + 1).alias("vertices"), (F.floor(F.sum("length") * 10 + 0.5) / 10).alias("length"))


_SQL_WIDE_REGIONS = _SQL_REGIONS.replace(f"SELECT row * 16 + col AS id, row, col, floor(value / 60) AS value FROM ({S.SQL_HOLES}) WHERE value IS NOT NULL", f"SELECT row * (SELECT max(col) + 1 FROM ({S.SQL_PLANE})) + col AS id, row, col, floor(value / 10) AS value FROM ({S.SQL_PLANE})")


@_query(
    f"{_SQL_WIDE_REGIONS} SELECT k.region::BIGINT AS region, k.value::DOUBLE AS value, (q1 + q3 + 2 * qd)::BIGINT AS corners, cells::DOUBLE AS area FROM k JOIN n ON n.region = k.region"
)
def wide_polygonize(spark: SparkSession, d: str) -> DataFrame:
    """Corners and area of each region's rings over plane(), from pieces of rings; holes run the other way round."""
    cells = S.plane(spark, d).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    grid = S.plane_grid(spark, d)
    return vector.polygonize(cells, grid, _tile(grid)).transform(_polygon_figures).select("region", "value", "corners", "area")


@_query(f"SELECT zone, count(*) AS count, median(value) AS median FROM (SELECT least(row, 1)::DOUBLE AS zone, value * 7 - col AS value FROM ({S.SQL_PLANE})) GROUP BY zone")
def wide_hot_zone(spark: SparkSession, d: str) -> DataFrame:
    """All rows but the first as one zone, whose median is found by counts of buckets."""
    cells = S.plane(spark, d).withColumn("value", F.col("value") * 7 - F.col("col"))
    zones = cells.withColumn("value", F.least("row", F.lit(1)).cast("double"))
    return zonal.zonal_stats(cells, zones, hot_cells=1000).select("zone", "count", "median")


@_query(f"WITH c AS (SELECT l_orderkey AS ord, min(l_quantity)::DOUBLE + l_orderkey % 90 AS lo, max(l_quantity)::DOUBLE + l_orderkey % 90 + 0.5 AS hi, l_orderkey::DOUBLE AS new FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey), v AS (SELECT DISTINCT value FROM ({S.SQL_PLANE})), m AS (SELECT value, min_by(new, ord) AS new FROM v JOIN c ON value >= lo AND value < hi GROUP BY value) SELECT p.row, p.col, m.new AS value FROM ({S.SQL_PLANE}) p LEFT JOIN m ON m.value = p.value")
def reclassify_table(spark: SparkSession, d: str) -> DataFrame:
    """As many overlapping classes as there are orders, from a table: the quantities of an order's first two lines, moved."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 2")
    moved, q = F.col("l_orderkey") % 90, F.col("l_quantity").cast("double")
    classes = lines.groupBy("l_orderkey").agg(F.min(q).alias("lo"), F.max(q).alias("hi"))
    classes = classes.select(F.col("l_orderkey").alias("ord"), (F.col("lo") + moved).alias("min"), (F.col("hi") + moved + 0.5).alias("max"), F.col("l_orderkey").cast("double").alias("new"))
    return algebra.reclassify_table(S.plane(spark, d), classes).select("row", "col", "value")


_SQL_NEAR_7 = f"WITH g AS MATERIALIZED ({S.SQL_PLANE}), w AS MATERIALIZED (SELECT g.row + dr AS row, g.col + dc AS col, value FROM g, range(-7, 8) AS a(dr), range(-7, 8) AS b(dc) WHERE dr * dr + dc * dc <= 49)"


@_query(f"{_SQL_NEAR_7} SELECT g.row, g.col, median(w.value) AS value FROM g JOIN w ON g.row = w.row AND g.col = w.col GROUP BY g.row, g.col")
def wide_focal_median(spark: SparkSession, d: str) -> DataFrame:
    """Circles of radius 7, in tiles."""
    grid = S.plane_grid(spark, d)
    return focal.focal_stats(S.plane(spark, d), 7, "circle", "median", _tile(grid)).select("row", "col", "value")


@_query(f"WITH p AS ({S.SQL_PLANE}) SELECT (row // 2)::INT AS row, (col // 2)::INT AS col, floor(avg(value) * 1e6 + 0.5) / 1e6 AS value FROM p GROUP BY 1, 2")
def wide_overview(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.overview(S.plane(spark, d)).select("row", "col", _cut("value"))


# -- water over plane() on a slope --


def flow_sql(cells: str, d8: str, width: str = "16") -> str:
    """t: cells of a grid (g) with their D8 directions and the cell `goal` that each flows into."""
    inside = lambda r, c: f"CASE WHEN row + {r} BETWEEN 0 AND w - 1 AND col + {c} BETWEEN 0 AND w - 1 THEN (row + {r}) * w + col + {c} END"
    goal = "CASE value::INT " + " ".join(f"WHEN {code} THEN {inside(r, c)}" for code, r, c, _ in terrain.D8) + " END"
    return f"g AS MATERIALIZED ({cells}), {d8}, t AS MATERIALIZED (SELECT row * w + col AS id, row, col, value, {goal} AS goal FROM d, (SELECT {width} AS w))"


_SQL_COUNT = "way(id, here) AS (SELECT id, goal FROM t WHERE goal IS NOT NULL UNION ALL SELECT w.id, t.goal FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NOT NULL), flow AS MATERIALIZED (SELECT here AS id, count(*) AS n FROM way GROUP BY here)"


def stream_sql(flow: str, threshold: float) -> str:
    """Orders by the queue itself, a cell at a time: cells come by their steps from the farthest headwater, and then by that headwater."""
    return (
        f"WITH RECURSIVE {flow}, {_SQL_COUNT}, s AS MATERIALIZED (SELECT t.id, t.row, t.col, t.goal FROM t LEFT JOIN flow ON flow.id = t.id WHERE t.value IS NOT NULL AND coalesce(n, 0) >= {threshold}), "
        "u AS MATERIALIZED (SELECT s.id, b.id AS goal FROM s LEFT JOIN s b ON b.id = s.goal), "
        "down(head, here, steps) AS (SELECT id, id, 0 FROM u WHERE id NOT IN (SELECT goal FROM u WHERE goal IS NOT NULL) UNION ALL SELECT d.head, u.goal, d.steps + 1 FROM down d JOIN u ON u.id = d.here WHERE u.goal IS NOT NULL), "
        "q AS MATERIALIZED (SELECT here AS id, row_number() OVER (ORDER BY max(row(steps, head))) AS k, max(steps) = 0 AS head FROM down GROUP BY here), "
        "e AS MATERIALIZED (SELECT q.k, g.k AS goal FROM q JOIN u ON u.id = q.id LEFT JOIN q g ON g.id = u.goal), "
        "run(k, o) AS (SELECT 0::BIGINT, list(head::INT ORDER BY k) FROM q UNION ALL SELECT e.k, CASE WHEN goal IS NULL THEN o ELSE o[:goal - 1] || [CASE WHEN o[goal] = o[e.k] THEN o[e.k] + 1 ELSE greatest(o[goal], o[e.k]) END] || o[goal + 1:] END FROM run JOIN e ON e.k = run.k + 1), "
        "z AS (SELECT o FROM run ORDER BY k DESC LIMIT 1), f AS (SELECT q.id, o[q.k]::DOUBLE AS value FROM q, z) "
        "SELECT t.row, t.col, f.value FROM t LEFT JOIN f ON f.id = t.id"
    )


def register_water(oracles: dict[str, str], d8: str) -> None:
    """SQL of the queries over ground()."""
    flow = flow_sql(S.SQL_GROUND, d8, "(SELECT max(col) + 1 FROM g)")
    oracles["wide_flow_accumulation"] = f"WITH RECURSIVE {flow}, {_SQL_COUNT} SELECT t.row, t.col, coalesce(n, 0)::DOUBLE AS value FROM t LEFT JOIN flow ON flow.id = t.id"
    oracles["wide_watershed"] = f"WITH RECURSIVE {flow}, way(id, here) AS (SELECT id, id FROM t UNION ALL SELECT w.id, t.goal FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NOT NULL), o AS MATERIALIZED (SELECT w.id, w.here AS outlet FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NULL), f AS (SELECT outlet, row_number() OVER (ORDER BY min(id)) AS label FROM o GROUP BY outlet) SELECT t.row, t.col, f.label::DOUBLE AS value FROM t JOIN o ON o.id = t.id JOIN f ON f.outlet = o.outlet"
    oracles["wide_stream_order"] = stream_sql(flow, _STREAM)
    oracles["wide_fill_sinks"] = (
        f"WITH RECURSIVE g AS MATERIALIZED ({S.SQL_GROUND}), m AS (SELECT max(row) AS last FROM g), o(dr, dc) AS (SELECT r, c FROM range(-1, 2) AS a(r), range(-1, 2) AS b(c) WHERE r <> 0 OR c <> 0), "
        "lv(row, col, level) USING KEY (row, col) AS (SELECT row, col, value FROM g, m WHERE row IN (0, last) OR col IN (0, last) "
        "UNION SELECT g.row, g.col, min(greatest(lv.level, g.value)) FROM lv JOIN o ON true JOIN g ON g.row = lv.row + dr AND g.col = lv.col + dc LEFT JOIN recurring.lv k ON k.row = g.row AND k.col = g.col WHERE k.level IS NULL OR greatest(lv.level, g.value) < k.level GROUP BY g.row, g.col) "
        "SELECT row::INT AS row, col::INT AS col, level AS value FROM lv"
    )


_STREAM = 40.0


def _ways(spark: SparkSession, d: str) -> DataFrame:
    return cut(terrain.flow_direction(S.ground(spark, d), 10.0))


def wide_flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    grid = S.plane_grid(spark, d)
    return hydro.flow_accumulation(_ways(spark, d), grid, _tile(grid)).select("row", "col", "value")


def wide_watershed(spark: SparkSession, d: str) -> DataFrame:
    grid = S.plane_grid(spark, d)
    return hydro.watershed(_ways(spark, d), grid, _tile(grid)).select("row", "col", "value")


def wide_stream_order(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells that 40 others flow into at least."""
    grid, ways = S.plane_grid(spark, d), _ways(spark, d)
    return hydro.stream_order(cut(hydro.flow_accumulation(ways, grid, _tile(grid))), ways, grid, _STREAM, _tile(grid)).select("row", "col", "value")


def wide_fill_sinks(spark: SparkSession, d: str) -> DataFrame:
    grid = S.plane_grid(spark, d)
    return hydro.fill_sinks(S.ground(spark, d), grid, _tile(grid)).select("row", "col", "value")


QUERIES |= {f.__name__: f for f in (wide_flow_accumulation, wide_watershed, wide_stream_order, wide_fill_sinks)}
