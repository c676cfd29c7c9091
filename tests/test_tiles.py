"""What is worked out tile by tile against plain walks over whole grids."""

import heapq
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid, InvalidInput
from gridweft.operators import hydro, terrain, vector, visibility
from gridweft.operators.chains import local_chains, ranked

STEPS = {code: (dr, dc) for code, dr, dc, _ in terrain.D8}


def frame(spark, values):
    """Two rasters of the same values, cells in no order."""
    rows = [(i, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values) for i in ("a", "b")]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, value double").repartition(5)


def back(cells, shape, name="value"):
    """The array of raster a, after a look that raster b is the same."""
    out = {i: np.full(shape, np.nan) for i in "ab"}
    for r in cells.collect():
        if r[name] is not None:
            out[r["raster_id"]][r["row"], r["col"]] = r[name]
    np.testing.assert_array_equal(out["a"], out["b"])
    return out["a"]


def terrain_like(seed, shape=(23, 29), holes=0.05, step=0.8):
    """A rough slope with pits, flats and holes."""
    r = np.random.default_rng(seed)
    z = np.floor(r.normal(0, 4, shape) + step * np.arange(shape[0])[:, None] + 0.3 * step * np.arange(shape[1]))
    z[r.random(shape) < holes] = np.nan
    return z


def ways(codes):
    """Cell to the cell that it flows into."""
    out = {}
    for (r, c), v in np.ndenumerate(codes):
        if not np.isnan(v):
            dr, dc = STEPS.get(int(v), (0, 0))
            to = (r + dr, c + dc)
            out[r, c] = to if (dr or dc) and 0 <= to[0] < codes.shape[0] and 0 <= to[1] < codes.shape[1] and not np.isnan(codes[to]) else None
    return out


def random_codes(seed, shape=(23, 29)):
    """Directions without cycles over ground without order: each cell flows to a lower neighbour of a random field, or nowhere."""
    r = np.random.default_rng(seed)
    z = r.random(shape) + 0.15 * np.arange(shape[0])[:, None]
    codes = np.zeros(shape)
    for (y, x), v in np.ndenumerate(z):
        lower = [k for k, (dr, dc) in STEPS.items() if 0 <= y + dr < shape[0] and 0 <= x + dc < shape[1] and z[y + dr, x + dc] < v]
        codes[y, x] = r.choice(lower) if lower else 0
    codes[r.random(shape) < 0.03] = np.nan
    return codes


@pytest.mark.parametrize(("seed", "tile"), [(1, 5), (2, 256), (3, 8)])
def test_flow(spark, seed, tile):
    codes = random_codes(seed)
    to, grid = ways(codes), Grid(codes.shape[1], codes.shape[0])
    count, outlet = np.where(np.isnan(codes), np.nan, 0.0), {}
    for cell in to:
        here = cell
        while to[here] is not None:
            here = to[here]
            count[here] += 1
        outlet[cell] = here
    cells = frame(spark, codes)
    np.testing.assert_array_equal(back(hydro.flow_accumulation(cells, grid, tile), codes.shape), count)
    label = {}
    wanted = np.full(codes.shape, np.nan)
    for cell in sorted(outlet):
        wanted[cell] = label.setdefault(outlet[cell], len(label) + 1)
    np.testing.assert_array_equal(back(hydro.watershed(cells, grid, tile), codes.shape), wanted)

    for threshold in (0.0, 3.0):
        stream = {c for c in to if count[c] >= threshold}
        waiting = dict.fromkeys(sorted(stream), 0)
        for c in stream:
            if to[c] in stream:
                waiting[to[c]] += 1
        reached = {c: 0 if n else 1 for c, n in waiting.items()}
        queue = deque(c for c in sorted(stream) if waiting[c] == 0)
        while queue:
            c = queue.popleft()
            goal = to[c]
            if goal in stream:
                reached[goal] = reached[c] + 1 if reached[goal] == reached[c] else max(reached[goal], reached[c])
                waiting[goal] -= 1
                if waiting[goal] == 0:
                    queue.append(goal)
        orders = np.full(codes.shape, np.nan)
        for c, o in reached.items():
            orders[c] = o
        flow = frame(spark, count)
        np.testing.assert_array_equal(back(hydro.stream_order(flow, cells, grid, threshold, tile), codes.shape), orders)
        assert np.nanmax(orders) >= 2


@pytest.mark.parametrize("tile", [2, 256])
def test_a_cycle_of_directions_is_an_error(spark, tile):
    codes = np.array([[1.0, 4.0, 0.0], [64.0, 16.0, 0.0]])
    with pytest.raises(Exception, match="cycle"):
        hydro.flow_accumulation(frame(spark, np.pad(codes, ((1, 1), (1, 1)))), Grid(5, 4), tile).collect()
    assert issubclass(InvalidInput, ValueError)


def flooded(z):
    """Levels by a queue of the lowest cells, from the grid's edge inwards."""
    h, w = z.shape
    level = np.full(z.shape, np.inf)
    heap = [(z[r, c], r, c) for r in range(h) for c in range(w) if (r in (0, h - 1) or c in (0, w - 1)) and not np.isnan(z[r, c])]
    for v, r, c in heap:
        level[r, c] = v
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        if v > level[r, c]:
            continue
        for dr, dc in STEPS.values():
            a, b = r + dr, c + dc
            if 0 <= a < h and 0 <= b < w and not np.isnan(z[a, b]) and max(v, z[a, b]) < level[a, b]:
                level[a, b] = max(v, z[a, b])
                heapq.heappush(heap, (level[a, b], a, b))
    return np.where(np.isinf(level), z, level)


@pytest.mark.parametrize(("seed", "tile", "holes"), [(1, 5, 0.05), (2, 256, 0.2), (3, 7, 0.35), (4, 3, 0.0)])
def test_sinks(spark, seed, tile, holes):
    z = terrain_like(seed, holes=holes)
    z[8:15, 9:20] -= 6  # a basin over several tiles
    found = back(hydro.fill_sinks(frame(spark, z), Grid(z.shape[1], z.shape[0]), tile), z.shape)
    np.testing.assert_array_equal(found, flooded(z))


# -- lines and rings --


def test_chains():
    """A path, a ring and a piece of its own, in one numbering."""
    start, end, key = np.array([3, 1, 2, 7, 5, 6, 9]), np.array([4, 2, 3, 5, 6, 7, 10]), np.array([10, 20, 30, 5, 4, 3, 0])
    order, heads, closed = local_chains(start, end, key)
    chains = {tuple(start[p].tolist()): bool(c) for p, c in zip(np.split(order, heads[1:]), closed, strict=True)}
    assert chains == {(1, 2, 3): False, (6, 7, 5): True, (9,): False}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_ranks_over_tiles(spark, n):
    ring = [("a", k, (k + 1) % n, 500 + (k * 7) % n if n % 7 else 500 + k, False) for k in range(n)] if n > 1 else []
    path = [("a", 1000 + k, 1001 + k, 100 + (k * 3) % n if n % 3 else 100 + k, False) for k in range(n)]
    rows = [*ring, *path, ("a", 5000, 5001, 9, False), ("a", 6000, 6000, 8, True)]
    found = {r["key"]: r for r in ranked(spark.createDataFrame(rows, "g string, start long, end long, key long, closed boolean"), ["g"]).collect()}
    assert len(found) == len(rows)
    for _, start, _, key, _ in path:
        r = found[key]
        assert (r["line"], r["seq"], r["n"], r["ring"]) == (min(p[3] for p in path), start - 1000, n, False)
    if ring:
        first = min(ring, key=lambda p: p[3])
        for _, start, _, key, _ in ring:
            r = found[key]
            assert (r["line"], r["seq"], r["n"], r["ring"]) == (first[3], (start - first[1]) % n, n, True)
    assert found[9]["ring"] is False and found[8]["ring"] is True and found[8]["n"] == 1


@pytest.mark.parametrize(("tile", "other"), [(4, 256), (7, 3)])
def test_contours_do_not_depend_on_tiles(spark, tile, other):
    z = terrain_like(6, holes=0.06)
    grid, cells = Grid(z.shape[1], z.shape[0], 10.0), frame(spark, z)
    found = [sorted((r["raster_id"], r["level"], r["line_id"], [tuple(p) for p in r["vertices"]]) for r in vector.contour_lines(cells, grid, 3.0, 0.5, t).collect()) for t in (tile, other)]
    assert found[0] == found[1]
    closed = [v for *_, v in found[0] if np.allclose(v[0], v[-1])]
    assert len(closed) > 5 and len(found[0]) > len(closed)
    segments = vector.contour_segments(cells, grid, 3.0, 0.5).collect()
    assert sum(len(v) - 1 for *_, v in found[0]) == len(segments)
    ends = {(r["raster_id"], r["level"], *np.round([r["x1"], r["y1"], r["x2"], r["y2"]], 6)) for r in segments}
    for i, level, _, v in found[0]:
        for p, q in zip(v, v[1:], strict=False):
            a, b = np.round(p, 6).tolist(), np.round(q, 6).tolist()
            assert (i, level, *a, *b) in ends or (i, level, *b, *a) in ends


def test_contours_run_and_are_numbered_by_their_least_segments(spark):
    z = terrain_like(9, holes=0.0)
    cells, grid = frame(spark, z).where("raster_id = 'a'"), Grid(z.shape[1], z.shape[0])
    lines = vector.contour_lines(cells, grid, 4.0, 0.5, 6).collect()
    place = {}
    for r in vector.contour_segments(cells, grid, 4.0, 0.5).collect():
        place[(r["level"], *np.round([r["x1"], r["y1"], r["x2"], r["y2"]], 6))] = (r["row"], r["col"], r["part"])
    by_level = defaultdict(list)
    for r in lines:
        pairs = [(r["level"], *np.round([p["x"], p["y"], q["x"], q["y"]], 6)) for p, q in zip(r["vertices"], r["vertices"][1:], strict=False)]
        either = [(place.get(p) or place[(p[0], *p[3:], *p[1:3])], p in place) for p in pairs]
        least, straight = min(either)
        assert straight
        if np.allclose(r["vertices"][0], r["vertices"][-1]):
            assert either[0][0] == least
        by_level[r["level"]].append((r["line_id"], least))
    for found in by_level.values():
        found.sort()
        assert [k for k, _ in found] == list(range(len(found))) and [p for _, p in found] == sorted(p for _, p in found)


def inside(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2


@pytest.mark.parametrize("tile", [4, 256])
def test_polygons_cover_their_regions(spark, tile):
    """Rings of every region hold just its cells, holes among them regions that lie in holes of others."""
    r = np.random.default_rng(7)
    z = np.floor(r.random((17, 19)) * 1.7)
    z[4:13, 4:13], z[5:12, 5:12], z[7:10, 7:10], z[8, 8] = 5, 6, 5, 6
    z[r.random(z.shape) < 0.05] = np.nan
    grid, cells = Grid(z.shape[1], z.shape[0]), frame(spark, z)
    owner = back(vector.label_regions(cells, grid, tile), z.shape, "region")
    rows = [x for x in vector.polygonize(cells, grid, tile).collect() if x["raster_id"] == "a"]
    assert len({x["region"] for x in rows}) == len(rows) == len(np.unique(owner[~np.isnan(owner)]))
    for x in rows:
        rings = [[tuple(p) for p in ring] for ring in x["rings"]]
        for ring in rings:
            assert ring[0] == ring[-1] and min(ring, key=lambda p: p[::-1]) == ring[0]
            assert all(len({p[0], q[0], s[0]}) > 1 and len({p[1], q[1], s[1]}) > 1 for p, q, s in zip(ring[:-1], ring[1:], [*ring[2:], ring[1]], strict=True))
        area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2 for ring in rings]
        assert area[0] > 0 and all(a < 0 for a in area[1:])
        held = {(r, c) for r in range(z.shape[0]) for c in range(z.shape[1]) if sum(inside(ring, c + 0.5, r + 0.5) for ring in rings) % 2}
        assert held == {tuple(p) for p in np.argwhere(owner == x["region"]).tolist()}
    assert vector.region_rings(cells, grid, tile).where(F.size("vertices") == 0).count() == 0


@pytest.mark.parametrize(("sectors", "at", "radius"), [(64, (9, 11), 9.0), (3, (0, 28), 14.5), (64, (22, 0), 40.0)])
def test_sight(spark, sectors, at, radius):
    """Sight lines sample by sample, over missing cells and beyond the last row and column."""
    r = np.random.default_rng(12)
    z = np.floor(r.random((23, 29)) * 40)
    z[r.random(z.shape) < 0.05] = np.nan
    z[at] = 20.0
    eye, (row, col) = z[at] + 15, at
    wanted = np.full(z.shape, np.nan)
    for (y, x), v in np.ndenumerate(z):
        length, steps = np.hypot(y - row, x - col), max(abs(y - row), abs(x - col))
        if np.isnan(v) or length > radius:
            continue
        wanted[y, x] = 1.0
        for k in range(1, steps):
            p, q = row + float(y - row) * (k / steps), col + float(x - col) * (k / steps)
            p0, q0 = int(np.floor(p)), int(np.floor(q))
            p1, q1, a, b = min(p0 + 1, 22), min(q0 + 1, 28), p - p0, q - q0
            ground = z[p0, q0] * ((1 - a) * (1 - b)) + z[p0, q1] * ((1 - a) * b) + z[p1, q0] * (a * (1 - b)) + z[p1, q1] * (a * b)
            if (ground - eye) / (length * (k / steps)) > (v - eye) / length:
                wanted[y, x] = 0.0
    found = back(visibility.viewshed(frame(spark, z), Grid(29, 23), row, col, 15.0, radius, sectors), z.shape)
    np.testing.assert_array_equal(found, wanted)
    assert (wanted == 0).sum() > 5
