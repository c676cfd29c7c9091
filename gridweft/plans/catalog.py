"""Registered queries and their oracle SQL.

Results that aren't whole numbers are cut to millionths in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.operators import algebra, focal, hydro, pyramid, terrain, timeseries, vector, visibility, zonal
from gridweft.plans import derived, files, surfaces as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _cut(column: str):
    return (F.floor(F.col(column) * 1e6 + 0.5) / 1e6).alias(column)


def _sql_cut(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 AS {name}"


def _cells(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("row", "col", *[_cut(c) for c in columns or ("value",)])


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# -- map algebra --

_UNARY_SQL = {"add": "value + 2.5", "multiply": "value * 2.5", "sqrt": "CASE WHEN value - 900 >= 0 THEN sqrt(value - 900) END", "abs": "abs(value - 900)", "log": "ln(value)"}
for _op, _sql in _UNARY_SQL.items():
    _shift = -900.0 if _op in ("sqrt", "abs") else 0.0
    _add(
        f"map_{_op}",
        lambda spark, d, op=_op, shift=_shift: _cells(algebra.apply_unary(algebra.apply_unary(S.holes(spark, d), "add", shift), op, 2.5)),
        f"SELECT row, col, {_sql_cut(_sql, 'value')} FROM ({S.SQL_HOLES})",
    )

_add("map_expression", lambda spark, d: _cells(algebra.expression(S.holes(spark, d), F.col("value") * 2 - F.col("row") * F.col("col"))), f"SELECT row, col, value * 2 - row * col AS value FROM ({S.SQL_HOLES})")

_BINARY_SQL = {
    "add": "a.value + b.value",
    "subtract": "a.value - b.value",
    "multiply": "a.value * b.value",
    "divide": "CASE WHEN b.value <> 0 THEN a.value / b.value END",
    "min": "CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN least(a.value, b.value) END",
    "max": "CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN greatest(a.value, b.value) END",
}


def _binary(spark: SparkSession, d: str, op: str) -> DataFrame:
    flipped = S.sales(spark, d).select("raster_id", F.col("col").alias("row"), F.col("row").alias("col"), (F.col("value") - F.when(F.col("row") == F.col("col"), F.col("value")).otherwise(0.0)).alias("value"))
    return _cells(algebra.apply_binary(S.holes(spark, d), flipped, op, S.SALES, S.SALES))


for _op, _sql in _BINARY_SQL.items():
    _add(
        f"bin_{_op}",
        lambda spark, d, op=_op: _binary(spark, d, op),
        f"WITH s AS ({S.SQL_SALES}), a AS ({S.SQL_HOLES}), b AS (SELECT col AS row, row AS col, CASE WHEN row = col THEN 0.0 ELSE value END AS value FROM s) SELECT a.row, a.col, {_sql_cut(_sql, 'value')} FROM a JOIN b ON a.row = b.row AND a.col = b.col",
    )

CLASSES = [(0.0, 300.0, 1.0), (200.0, 1_000.0, 2.0), (1_000.0, 6_000.0, 3.0), (6_000.0, 6_100.0, 4.0), (6_100.0, 1e9, 5.0)]
_CLASS_SQL = "CASE " + " ".join(f"WHEN value >= {a} AND value < {b} THEN {c}" for a, b, c in CLASSES) + " END"
_add("reclassify", lambda spark, d: _cells(algebra.reclassify(S.holes(spark, d), CLASSES)), f"SELECT row, col, ({_CLASS_SQL})::DOUBLE AS value FROM ({S.SQL_HOLES})")
for _name, _eps in (("normdiff_eps", 1e-10), ("normdiff_exact", 0.0)):
    _add(_name, lambda spark, d, eps=_eps: _cells(algebra.normalized_difference(*S.bands(spark, d), eps)), f"SELECT row, col, {_sql_cut(f'CASE WHEN abs(tax + discount) > {_eps} THEN (tax - discount) / (tax + discount) END', 'value')} FROM ({S.SQL_BANDS})")

# -- terrain --

_SQL_NEAR = """r AS (SELECT *, lag(value) OVER w AS w, lead(value) OVER w AS e FROM g WINDOW w AS (PARTITION BY row ORDER BY col)),
n AS (SELECT *, lag(value) OVER c AS n, lag(w) OVER c AS nw, lag(e) OVER c AS ne, lead(value) OVER c AS s, lead(w) OVER c AS sw, lead(e) OVER c AS se FROM r WINDOW c AS (PARTITION BY col ORDER BY row))"""


def _sql_gradient(cell_size: float) -> str:
    return f"h AS (SELECT row, col, ((ne + e * 2 + se) - (nw + w * 2 + sw)) / {8 * cell_size} AS dx, ((sw + s * 2 + se) - (nw + n * 2 + ne)) / {8 * cell_size} AS dy FROM n)"


_SHADE = "greatest(0.0, least(255.0, 255.0 * (cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(dy, -dx)))))"
_TERRAIN_SQL = {
    "slope": "degrees(atan(sqrt(dx * dx + dy * dy)))",
    "aspect": "CASE WHEN dx <> 0 OR dy <> 0 THEN CASE WHEN 90 - degrees(atan2(dy, -dx)) < 0 THEN 450 - degrees(atan2(dy, -dx)) ELSE 90 - degrees(atan2(dy, -dx)) END END",
    "hillshade": f"CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN {_SHADE} END",
}
for _op, _sql in _TERRAIN_SQL.items():
    _add(_op, lambda spark, d, op=_op: _cells(getattr(terrain, op)(S.surface(spark, d), 0.05)), f"WITH g AS ({S.SQL_SURFACE}), {_SQL_NEAR}, {_sql_gradient(0.05)} SELECT row, col, {_sql_cut(_sql, 'value')} FROM h")
_add("slope_holes", lambda spark, d: _cells(terrain.slope(S.holes(spark, d), 10.0)), f"WITH g AS ({S.SQL_HOLES}), {_SQL_NEAR}, {_sql_gradient(10.0)} SELECT row, col, {_sql_cut(_TERRAIN_SQL['slope'], 'value')} FROM h")

_DROPS = [(code, name, 10.0 * (2**0.5 if len(name) == 2 else 1.0)) for code, _, _, name in terrain.D8]
_SQL_DROPS = ", ".join(f"coalesce((value - {name}) / {dist!r}, 0.0) AS d{code}" for code, name, dist in _DROPS)
_SQL_CODE = "CASE WHEN value IS NULL THEN NULL WHEN greatest(" + ", ".join(f"d{c}" for c, *_ in _DROPS) + ") <= 0 THEN 0.0 " + " ".join(f"WHEN d{c} = greatest(" + ", ".join(f"d{k}" for k, *_ in _DROPS) + f") THEN {c}.0" for c, *_ in _DROPS) + " END"
_SQL_D8 = f"{_SQL_NEAR}, drops AS (SELECT *, {_SQL_DROPS} FROM n), d AS (SELECT row, col, ({_SQL_CODE})::DOUBLE AS value FROM drops)"
_add("flow_direction", lambda spark, d: _cells(terrain.flow_direction(S.holes(spark, d), 10.0)), f"WITH g AS ({S.SQL_HOLES}), {_SQL_D8} SELECT row, col, value FROM d")

# -- focal --

_FOCAL_SQL = {"min": "min(b.value)", "max": "max(b.value)", "mean": "avg(b.value)", "sum": "sum(b.value)", "std": "stddev_pop(b.value)", "median": "median(b.value)", "range": "max(b.value) - min(b.value)"}
for _shape in focal.SHAPES:
    _near = "b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2" + (" AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 4" if _shape == "circle" else "")
    for _stat in focal.STATS:
        if _stat == "majority":
            _sql = f"WITH g AS (SELECT row, col, floor(value / 40) AS value FROM ({S.SQL_HOLES})), p AS (SELECT a.row, a.col, b.value, count(*) AS n FROM g a JOIN g b ON {_near} WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL), m AS (SELECT row, col, value FROM p QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1) SELECT g.row, g.col, m.value FROM g LEFT JOIN m ON g.row = m.row AND g.col = m.col"
        else:
            _sql = f"WITH g AS ({S.SQL_HOLES}) SELECT a.row, a.col, {_sql_cut(f'CASE WHEN any_value(a.value) IS NOT NULL THEN {_FOCAL_SQL[_stat]} END', 'value')} FROM g a JOIN g b ON {_near} GROUP BY a.row, a.col"

        def _focal(spark: SparkSession, d: str, shape: str, stat: str) -> DataFrame:
            cells = S.holes(spark, d)
            if stat == "majority":
                cells = cells.withColumn("value", F.floor(F.col("value") / 40).cast("double"))
            return _cells(focal.focal_stats(cells, 2, shape, stat))

        _add(f"focal_{_stat}_{_shape}", lambda spark, d, shape=_shape, stat=_stat: _focal(spark, d, shape, stat), _sql)

# -- zones and time series --

_STATS = ("min", "max", "mean", "sum", "std", "median")


def _zonal(spark: SparkSession, d: str) -> DataFrame:
    zones = S.sales(spark, d).withColumn("value", F.when(F.col("col") != 5, (F.col("row") % 4).cast("double")))
    return zonal.zonal_stats(S.holes(spark, d), zones, S.SALES, S.SALES).select("zone", "count", *[_cut(c) for c in _STATS])


_add("zonal_stats", _zonal, f"SELECT (row % 4)::DOUBLE AS zone, count(value) AS count, {', '.join(_sql_cut(f'{f}(value)', c) for f, c in zip(('min', 'max', 'avg', 'sum', 'stddev_pop', 'median'), _STATS, strict=True))} FROM ({S.SQL_HOLES}) WHERE col <> 5 AND value IS NOT NULL GROUP BY 1")
for _op, _fn in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"), ("stddev", "stddev_pop")):
    _add(f"composite_{_op}", lambda spark, d, op=_op: _cells(timeseries.composite(S.years(spark, d), op)), f"SELECT row, col, {_sql_cut(f'{_fn}(value)', 'value')} FROM ({S.SQL_YEARS}) GROUP BY row, col")
_add(
    "linear_trend",
    lambda spark, d: _cells(timeseries.linear_trend(S.years(spark, d)), "slope", "intercept", "r_squared"),
    f"WITH y AS ({S.SQL_YEARS}), f AS (SELECT row, col, count(value) AS n, var_pop(t) AS vt, var_pop(value) AS vv, covar_pop(value, t) AS c, avg(t) AS mt, avg(value) AS mv FROM y GROUP BY row, col) SELECT row, col, {_sql_cut('CASE WHEN n > 1 AND vt > 0 THEN c / vt END', 'slope')}, {_sql_cut('CASE WHEN n > 1 AND vt > 0 THEN mv - c / vt * mt END', 'intercept')}, {_sql_cut('CASE WHEN n > 1 AND vt > 0 THEN CASE WHEN vv = 0 THEN 0 ELSE c * c / (vt * vv) END END', 'r_squared')} FROM f",
)
_add(
    "change_detection",
    lambda spark, d: _cells(timeseries.change_detection(S.years(spark, d), 100.0, S.LAYERS), "magnitude", "changed"),
    f"WITH c AS (SELECT row, col, abs(max(value) FILTER (t_idx = 6) - max(value) FILTER (t_idx = 0)) AS m FROM ({S.SQL_YEARS}) GROUP BY row, col) SELECT row, col, {_sql_cut('m', 'magnitude')}, CASE WHEN m IS NOT NULL THEN CASE WHEN m >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS changed FROM c",
)
_add(
    "anomaly_zscore",
    lambda spark, d: _cells(timeseries.anomaly_zscore(S.years(spark, d), S.LAYERS)),
    f"WITH c AS (SELECT row, col, count(value) FILTER (t_idx < 6) AS n, avg(value) FILTER (t_idx < 6) AS m, stddev_pop(value) FILTER (t_idx < 6) AS s, max(value) FILTER (t_idx = 6) AS v FROM ({S.SQL_YEARS}) GROUP BY row, col) SELECT row, col, {_sql_cut('CASE WHEN n > 1 AND v IS NOT NULL THEN CASE WHEN s <= 1e-10 THEN 0 ELSE (v - m) / s END END', 'value')} FROM c",
)
_add(
    "phenology",
    lambda spark, d: _cells(timeseries.phenology(S.years(spark, d), 0.3), "start_of_season", "peak", "end_of_season", "max_value"),
    f"WITH y AS ({S.SQL_YEARS}), c AS (SELECT row, col, count(value) AS n, min(value) AS lo, max(value) AS hi FROM y GROUP BY row, col), p AS (SELECT y.row, y.col, max(y.t_idx) AS pk FROM y JOIN c ON y.row = c.row AND y.col = c.col AND y.value = c.hi GROUP BY ALL) SELECT c.row, c.col, {_sql_cut('CASE WHEN any_value(n) > 2 AND any_value(hi - lo) >= 1e-10 THEN min(t) FILTER (t_idx < pk AND value >= lo + (hi - lo) * 0.3) END', 'start_of_season')}, {_sql_cut('CASE WHEN any_value(n) > 2 AND any_value(hi - lo) >= 1e-10 THEN max(t) FILTER (t_idx = pk) END', 'peak')}, {_sql_cut('CASE WHEN any_value(n) > 2 AND any_value(hi - lo) >= 1e-10 THEN min(t) FILTER (t_idx > pk AND value < lo + (hi - lo) * 0.3) END', 'end_of_season')}, {_sql_cut('CASE WHEN any_value(n) > 2 AND any_value(hi - lo) >= 1e-10 THEN any_value(hi) END', 'max_value')} FROM y JOIN c ON y.row = c.row AND y.col = c.col JOIN p ON p.row = c.row AND p.col = c.col GROUP BY c.row, c.col",
)

# -- pyramids, windows, tiles --

_HALF = "SELECT (row // 2)::INT AS row, (col // 2)::INT AS col, avg(value) AS value FROM ({}) GROUP BY 1, 2"
_add("overview_1", lambda spark, d: _cells(pyramid.overview(S.holes(spark, d))), f"SELECT row, col, {_sql_cut('value', 'value')} FROM ({_HALF.format(S.SQL_HOLES)})")
_add("overview_2", lambda spark, d: _cells(pyramid.generate_overviews(S.holes(spark, d), 2)[1]), f"SELECT row, col, {_sql_cut('value', 'value')} FROM ({_HALF.format(_HALF.format(S.SQL_HOLES))})")
_add(
    "extract_tile",
    lambda spark, d: _cells(pyramid.extract_tile(S.holes(spark, d), S.SALES, 1, 1, 10, 10)),
    f"WITH f AS (SELECT r::INT AS row, c::INT AS col FROM generate_series(0, 9) AS a(r), generate_series(0, 9) AS b(c)) SELECT f.row, f.col, g.value FROM f LEFT JOIN ({S.SQL_HOLES}) g ON g.row = f.row + 10 AND g.col = f.col + 10",
)
_add("window_read", lambda spark, d: _cells(pyramid.window(S.surface(spark, d), 5, 20, 30, 40)), f"SELECT row - 20 AS row, col - 5 AS col, {_sql_cut('value', 'value')} FROM ({S.SQL_SURFACE}) WHERE row BETWEEN 20 AND 59 AND col BETWEEN 5 AND 34")

# -- vectors --

POLYGONS = [
    (1, 3.0, [[(10.0, 10.0), (121.0, 20.0), (90.0, 130.0), (10.0, 10.0)]]),
    (2, 7.0, [[(40.0, 40.0), (157.0, 40.0), (157.0, 150.0), (40.0, 150.0), (40.0, 40.0)], [(70.0, 70.0), (70.0, 100.0), (110.0, 100.0), (110.0, 70.0), (70.0, 70.0)]]),
]


def _rasterize(spark: SparkSession, d: str) -> DataFrame:
    shapes = spark.createDataFrame([(k, v, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, v, rings in POLYGONS], f"poly_ord int, value double, rings array<{vector._POINT}>")
    return vector.rasterize(shapes, S.SALES, (0.0, 0.0, 160.0, 160.0)).select("row", "col", "value")


_EDGES = ", ".join(f"({k}, {v}::DOUBLE, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, v, rings in POLYGONS for ring in rings for a, b in zip(ring, ring[1:], strict=False))
_add(
    "rasterize",
    _rasterize,
    f"WITH e(k, v, x1, y1, x2, y2) AS (VALUES {_EDGES}), f AS (SELECT r::INT AS row, c::INT AS col, 160 - (r + 0.5) * 10 AS y, (c + 0.5) * 10 AS x FROM generate_series(0, 15) AS a(r), generate_series(0, 15) AS b(c)), h AS (SELECT f.row, f.col, k, any_value(v) AS v FROM f JOIN e ON (y1 > y) <> (y2 > y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x GROUP BY f.row, f.col, k HAVING count(*) % 2 = 1), t AS (SELECT row, col, max_by(v, k) AS v FROM h GROUP BY row, col) SELECT f.row, f.col, t.v AS value FROM f LEFT JOIN t ON t.row = f.row AND t.col = f.col",
)

_STEP = 40.0


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return vector.contour_segments(S.holes(spark, d).withColumn("value", F.col("value") % 400), S.SALES, _STEP).select("level", "row", "col", "part", *[_cut(c) for c in ("x1", "y1", "x2", "y2")])


_POINTS = {"T": ("x0 + (CASE WHEN abs(tr - tl) < 1e-12 THEN 0.5 ELSE (l - tl) / (tr - tl) END) * 10", "y0"), "R": ("x0 + 10", "y0 - (CASE WHEN abs(br - tr) < 1e-12 THEN 0.5 ELSE (l - tr) / (br - tr) END) * 10"), "B": ("x0 + (CASE WHEN abs(br - bl) < 1e-12 THEN 0.5 ELSE (l - bl) / (br - bl) END) * 10", "y0 - 10"), "L": ("x0", "y0 - (CASE WHEN abs(bl - tl) < 1e-12 THEN 0.5 ELSE (l - tl) / (bl - tl) END) * 10")}
_CASES = [(k, "TRUE", 0, e) for k, e in vector.SEGMENTS.items()] + [(k, f"(tl + tr + br + bl) / 4 {sign} l", part, e) for k, pair in vector.SADDLES.items() for sign, es in zip((">=", "<"), pair, strict=True) for part, e in enumerate(es)]


def _segments_sql(base: float, cells: str = f"SELECT row, col, value % 400 AS value FROM ({S.SQL_HOLES})", step: float = _STEP) -> str:
    blocks = f"g AS ({cells}), m AS (SELECT ceil((min(value) - {base}) / {step}) * {step} + {base} AS a, max(value) AS b, max(row) AS rows FROM g), lv AS (SELECT a + i * {step} AS l FROM m, generate_series(0, 100) AS s(i) WHERE a + i * {step} <= b), q AS (SELECT a.row, a.col, a.value AS tl, b.value AS tr, c.value AS br, d.value AS bl, a.col * 10.0 AS x0, ((SELECT rows FROM m) - a.row) * 10.0 AS y0 FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN g d ON d.row = a.row + 1 AND d.col = a.col WHERE a.value + b.value + c.value + d.value IS NOT NULL), k AS (SELECT *, (tl >= l)::INT + 2 * (tr >= l)::INT + 4 * (br >= l)::INT + 8 * (bl >= l)::INT AS kind FROM q, lv)"
    return f"WITH {blocks} " + " UNION ALL ".join(f"SELECT l::DOUBLE AS level, row, col, {part}::INT AS part, {_sql_cut(_POINTS[e[0]][0], 'x1')}, {_sql_cut(_POINTS[e[0]][1], 'y1')}, {_sql_cut(_POINTS[e[1]][0], 'x2')}, {_sql_cut(_POINTS[e[1]][1], 'y2')} FROM k WHERE kind = {kind} AND {test}" for kind, test, part, e in _CASES)


_SQL_SEGMENTS = _segments_sql(0.0)
_add("contour_segments", _segments, _SQL_SEGMENTS)
_add("contour_levels", lambda spark, d: _segments(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n_segments")), f"SELECT level, count(*) AS n_segments FROM ({_SQL_SEGMENTS}) GROUP BY level")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return S.holes(spark, d).withColumn("value", F.floor(F.col("value") / 60))


_add(
    "polygonize_regions",
    lambda spark, d: vector.label_regions(_classes(spark, d), S.SALES).groupBy(F.col("region").cast("long").alias("region"), F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("cells")),
    f"WITH RECURSIVE g AS (SELECT row * 16 + col AS id, row, col, floor(value / 60) AS value FROM ({S.SQL_HOLES}) WHERE value IS NOT NULL), e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1), reach(id, other) AS (SELECT id, id FROM g UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other), l AS (SELECT id, min(other) AS region FROM reach GROUP BY id) SELECT l.region::BIGINT AS region, g.value::DOUBLE AS value, count(*) AS cells FROM l JOIN g ON g.id = l.id GROUP BY ALL",
)

# -- hydrology and sight --

_FLOW_SQL = f"g AS ({S.SQL_HOLES}), {_SQL_D8}, t AS (SELECT row * 16 + col AS id, row, col, value, " + "CASE value::INT " + " ".join(f"WHEN {c} THEN CASE WHEN row + {r} BETWEEN 0 AND 15 AND col + {k} BETWEEN 0 AND 15 THEN (row + {r}) * 16 + col + {k} END" for c, r, k, _ in terrain.D8) + " END AS goal FROM d)"


def _directions(spark: SparkSession, d: str) -> DataFrame:
    return terrain.flow_direction(S.holes(spark, d), 10.0)


_add(
    "flow_accumulation",
    lambda spark, d: _cells(hydro.flow_accumulation(_directions(spark, d), S.SALES)),
    f"WITH RECURSIVE {_FLOW_SQL}, way(id, here) AS (SELECT id, goal FROM t WHERE goal IS NOT NULL UNION ALL SELECT w.id, t.goal FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NOT NULL) SELECT t.row, t.col, CASE WHEN any_value(t.value) IS NOT NULL THEN count(w.id)::DOUBLE END AS value FROM t LEFT JOIN way w ON w.here = t.id GROUP BY t.row, t.col",
)
_add(
    "watershed",
    lambda spark, d: _cells(hydro.watershed(_directions(spark, d), S.SALES)),
    f"WITH RECURSIVE {_FLOW_SQL}, way(id, here) AS (SELECT id, id FROM t WHERE value IS NOT NULL UNION ALL SELECT w.id, t.goal FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NOT NULL), o AS (SELECT w.id, w.here AS outlet FROM way w JOIN t ON t.id = w.here WHERE t.goal IS NULL), f AS (SELECT outlet, row_number() OVER (ORDER BY min(id)) AS label FROM o GROUP BY outlet) SELECT t.row, t.col, f.label::DOUBLE AS value FROM t LEFT JOIN o ON o.id = t.id LEFT JOIN f ON f.outlet = o.outlet",
)
_add("stream_order", lambda spark, d: _cells(hydro.stream_order(hydro.flow_accumulation(_directions(spark, d), S.SALES), _directions(spark, d), S.SALES, 2.0)), derived.stream_sql(derived.flow_sql(S.SQL_HOLES, _SQL_D8), 2.0))
_add(
    "fill_sinks",
    lambda spark, d: _cells(hydro.fill_sinks(S.holes(spark, d), S.SALES, tile=8)),
    f"WITH RECURSIVE g AS (SELECT row * 16 + col AS id, row, col, value FROM ({S.SQL_HOLES})), lv AS (SELECT DISTINCT value AS l FROM g WHERE value IS NOT NULL), e AS (SELECT a.id AS a, b.id AS b, b.value AS z FROM g a JOIN g b ON greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL), way(id, l) AS (SELECT id, value FROM g WHERE value IS NOT NULL AND (row IN (0, 15) OR col IN (0, 15)) UNION SELECT e.b, greatest(w.l, e.z) FROM way w JOIN e ON e.a = w.id) SELECT g.row, g.col, CASE WHEN any_value(g.row) IN (0, 15) OR any_value(g.col) IN (0, 15) THEN any_value(g.value) ELSE coalesce(min(w.l), any_value(g.value)) END AS value FROM g LEFT JOIN way w ON w.id = g.id GROUP BY g.row, g.col",
)
_add(
    "viewshed",
    lambda spark, d: _cells(visibility.viewshed(S.holes(spark, d), S.SALES, 7, 7, 50.0, 70.0)),
    f"WITH g AS ({S.SQL_HOLES}), o AS (SELECT value + 50 AS eye FROM g WHERE row = 7 AND col = 7), t AS (SELECT g.row, g.col, value, eye, (row - 7)::DOUBLE AS dr, (col - 7)::DOUBLE AS dc, sqrt((row - 7) * (row - 7) + (col - 7) * (col - 7)) AS len, greatest(abs(row - 7), abs(col - 7)) AS steps FROM g, o WHERE value IS NOT NULL AND eye IS NOT NULL), s AS (SELECT *, i::DOUBLE / steps AS f, 7 + dr * (i::DOUBLE / steps) AS r, 7 + dc * (i::DOUBLE / steps) AS c FROM t, generate_series(1, 15) AS k(i) WHERE i < steps AND len <= 7), q AS (SELECT s.*, r - floor(r) AS y, c - floor(c) AS x FROM s), h AS (SELECT DISTINCT q.row, q.col FROM q JOIN g a ON a.row = floor(r) AND a.col = floor(c) JOIN g b ON b.row = floor(r) AND b.col = least(floor(c) + 1, 15) JOIN g p ON p.row = least(floor(r) + 1, 15) AND p.col = floor(c) JOIN g z ON z.row = least(floor(r) + 1, 15) AND z.col = least(floor(c) + 1, 15) WHERE (a.value * ((1 - y) * (1 - x)) + b.value * ((1 - y) * x) + p.value * (y * (1 - x)) + z.value * (y * x) - eye) / (len * f) > (q.value - eye) / len) SELECT g.row, g.col, CASE WHEN t.row IS NULL OR t.len > 7 THEN NULL WHEN h.row IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM g LEFT JOIN t ON t.row = g.row AND t.col = g.col LEFT JOIN h ON h.row = g.row AND h.col = g.col",
)

derived.register_functions(ORACLES, _sql_cut)
derived.register_wide(ORACLES, _SQL_NEAR)
derived.register_water(ORACLES, _SQL_D8)
_add("contour_lines", derived.contour_lines, derived.contour_sql(_segments_sql(0.5)))
_add("wide_contour_lines", derived.wide_contour_lines, derived.contour_sql(_segments_sql(40.5, S.SQL_PLANE, 80.0).replace("* 10", "* 1").replace("+ 10", "+ 1").replace("- 10", "- 1")).replace("sum(n) * 1e3 + 0.5) / 1e3", "sum(n) * 10 + 0.5) / 10"))
_add("flat_contours", derived.flat_contours, f"SELECT level, lines, vertices, vertices AS pairs FROM ({derived.contour_sql(_segments_sql(0.5))})")
for _module in (files, derived):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
