"""Between grids and vectors: contours, region polygons, rasterised polygons."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid, cols_window, rows_window
from gridweft.functions.rounds import cut, numbered
from gridweft.operators.chains import local_chains, ranked
from gridweft.operators.hydro import TILE
from gridweft.ship import ship

#: Marching-squares segments by case (bits: 1 top left, 2 top right, 4 bottom
#: right, 8 bottom left), each from edge to edge; saddles are below.
SEGMENTS = {1: "LT", 2: "TR", 3: "LR", 4: "RB", 6: "TB", 7: "LB", 8: "BL", 9: "BT", 11: "BR", 12: "RL", 13: "RT", 14: "TL"}
#: Both segments of a saddle if the mean of the corners reaches the level, and if not.
SADDLES = {5: (("LT", "RB"), ("LB", "TR")), 10: (("TR", "BL"), ("LT", "RB"))}
_POINT = "array<struct<x:double,y:double>>"


def contour_levels(cells: DataFrame, interval: float, base: float = 0.0) -> list[float]:
    """Levels from the first at or above the least value, by repeated addition up to the greatest."""
    if interval <= 0:
        return []
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return []
    levels, level = [], math.ceil((low - base) / interval) * interval + base
    while level <= high:
        levels.append(level)
        level += interval
    return levels


def contour_segments(cells: DataFrame, grid: Grid, interval: float, base: float = 0.0) -> DataFrame:
    """(raster_id, level, row, col, part, x1, y1, x2, y2): marching squares over every 2x2 block with data.

    A block is only copied for the levels between its own least and greatest value.
    """
    return _segments(cells, grid, interval, base).drop("case", "high")


def _sides() -> dict[str, str]:
    """The edges of each segment by case, whether a saddle's mean reaches the level, and part."""
    plain = {f"{number}:{high}:0": edges for number, edges in SEGMENTS.items() for high in ("true", "false")}
    return plain | {f"{number}:{high}:{part}": e for number, pair in SADDLES.items() for high, es in zip(("true", "false"), pair, strict=True) for part, e in enumerate(es)}


def _segments(cells: DataFrame, grid: Grid, interval: float, base: float) -> DataFrame:
    """contour_segments() with the case and whether the corners' mean reaches the level."""
    levels = contour_levels(cells, interval, base) if min(grid.width, grid.height) > 1 else []
    right = cells.withColumn("tr", F.lead("value").over(rows_window()))
    block = right.withColumn("bl", F.lead("value").over(cols_window())).withColumn("br", F.lead("tr").over(cols_window())).withColumnRenamed("value", "tl")
    block = block.where("tl is not null and tr is not null and bl is not null and br is not null")
    corners = [F.col(c) for c in ("tl", "tr", "br", "bl")]
    table = F.array(*[F.lit(x) for x in levels]).cast("array<double>")
    if levels:
        first = F.floor((F.least(*corners) - levels[0]) / interval).cast("int")
        last = F.ceil((F.greatest(*corners) - levels[0]) / interval).cast("int")
        start = F.greatest(first, F.lit(0))
        table = F.slice(table, start + 1, F.greatest(F.least(last + 2, F.lit(len(levels))) - start, F.lit(0)))
    block = block.withColumn("level", F.explode(table))
    case = sum((F.when(c >= F.col("level"), 1 << k).otherwise(0) for k, c in enumerate(corners[1:], 1)), F.when(corners[0] >= F.col("level"), 1).otherwise(0))
    block = block.withColumn("case", case).where(~F.col("case").isin(0, 15))
    cs = grid.cell_size
    x0, y0, level = F.col("col") * F.lit(cs), (F.lit(grid.height - 1) - F.col("row")) * F.lit(cs), F.col("level")

    def along(a: str, b: str):
        span = F.col(b) - F.col(a)
        return F.when(F.abs(span) < 1e-12, 0.5).otherwise((level - F.col(a)) / span)

    places = {"T": (x0 + along("tl", "tr") * cs, y0), "R": (x0 + cs, y0 - along("tr", "br") * cs), "B": (x0 + along("bl", "br") * cs, y0 - cs), "L": (x0, y0 - along("tl", "bl") * cs)}

    def segment(edges: str, part: int):
        (x1, y1), (x2, y2) = places[edges[0]], places[edges[1]]
        return F.struct(F.lit(part).alias("part"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    mean = (F.col("tl") + F.col("tr") + F.col("br") + F.col("bl")) / 4
    found = None
    for number, edges in SEGMENTS.items():
        here, one = F.col("case") == number, F.array(segment(edges, 0))
        found = F.when(here, one) if found is None else found.when(here, one)
    for number, (high, low) in SADDLES.items():
        pair = F.when(mean >= level, F.array(*[segment(e, k) for k, e in enumerate(high)])).otherwise(F.array(*[segment(e, k) for k, e in enumerate(low)]))
        found = found.when(F.col("case") == number, pair)
    return block.select("raster_id", "level", "row", "col", "case", (mean >= level).alias("high"), F.explode(found).alias("s")).select("raster_id", "level", "row", "col", "case", "high", "s.*")


#: Segments whose table direction has the higher side to the right, by case and edges; they are chained the other way round.
_TURNED = {(5, "TR"), (10, "LT"), (10, "RB")}


def _nodes(edge: Column, grid: Grid) -> Column:
    """A number for the grid edge that a side of a block is: twice the cell at its west or north end, one more for vertical ones."""
    cell = F.col("row").cast("long") * grid.width + F.col("col")
    return F.when(edge == "T", 2 * cell).when(edge == "B", 2 * (cell + grid.width)).when(edge == "L", 2 * cell + 1).otherwise(2 * (cell + 1) + 1)


def _tile_lines(table: pa.Table) -> pa.Table:
    """Chains of a tile's segments of one level: end nodes, least segment, its place and direction, vertices."""
    start, end, key = (table[c].to_numpy() for c in ("start", "end", "key"))
    turned = table["turned"].to_numpy(zero_copy_only=False)
    x1, y1, x2, y2 = (table[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    order, heads, closed = local_chains(start, end, key)
    tails = np.append(heads[1:], len(order)) - 1
    sizes = tails - heads + 1
    least = np.minimum.reduceat(key[order], heads)
    at = np.flatnonzero(key[order] == np.repeat(least, sizes))
    chain = np.repeat(np.arange(len(heads)), sizes)
    ends = np.concatenate([heads + np.arange(len(heads)), tails + np.arange(len(heads)) + 1])
    xs, ys = np.empty(len(order) + len(heads)), np.empty(len(order) + len(heads))
    place = np.arange(len(order)) + chain
    xs[place], ys[place] = x1[order], y1[order]
    xs[ends[len(heads) :]], ys[ends[len(heads) :]] = x2[order[tails]], y2[order[tails]]
    offsets = pa.array(np.append(ends[: len(heads)], len(xs)).astype(np.int32))
    points = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], ["x", "y"]))
    n = len(heads)
    return pa.table({
        "raster_id": pa.array([table["raster_id"][0].as_py()] * n, pa.string()), "level": pa.array([table["level"][0].as_py()] * n, pa.float64()),
        "start": start[order[heads]], "end": end[order[tails]], "key": least, "closed": pa.array(closed), "at": pa.array((at - heads).astype(np.int32)), "turned": pa.array(turned[order[at]]), "vertices": points,
    })


def contour_chains(cells: DataFrame, grid: Grid, interval: float, base: float = 0.0, tile: int = TILE) -> DataFrame:
    """(raster_id, level, line_id, seq, closed, vertices): contours in pieces of a tile at most.

    A line's pieces follow each other by seq, each beginning with the vertex that ended the
    one before; a closed line ends with its first vertex. Lines of a level are numbered from 0
    by their least segment (row, col, part), run in that segment's direction and begin with it
    if closed. Two segments follow each other where they cross the same edge of the grid, so
    each crossing joins two at most, at a level that equals cells too. A tile's segments of
    one level are the most that one task holds.
    """
    ship(cells.sparkSession)
    sides = F.element_at(F.create_map(*[F.lit(x) for number, pair in _sides().items() for x in (number, pair)]), F.concat_ws(":", F.col("case").cast("string"), F.col("high").cast("string"), F.col("part").cast("string")))
    segments = _segments(cells, grid, interval, base).withColumn("edges", sides)
    turned = F.concat_ws("", F.col("case").cast("string"), "edges").isin(*[f"{c}{e}" for c, e in _TURNED])
    a, b = F.substring("edges", 1, 1), F.substring("edges", 2, 1)
    segments = segments.withColumn("turned", turned)
    flip = lambda one, two: F.when(F.col("turned"), two).otherwise(one)
    key = 2 * (F.col("row").cast("long") * grid.width + F.col("col")) + F.col("part")
    ways = segments.select(
        "raster_id", "level", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), key.alias("key"), "turned",
        _nodes(flip(a, b), grid).alias("start"), _nodes(flip(b, a), grid).alias("end"), *[flip(F.col(f"{c}1"), F.col(f"{c}2")).alias(f"{c}1") for c in "xy"], *[flip(F.col(f"{c}2"), F.col(f"{c}1")).alias(f"{c}2") for c in "xy"],
    )
    within = ["raster_id", "level"]
    chains = cut(ways.groupBy(*within, "tr", "tc").applyInArrow(_tile_lines, f"raster_id string, level double, start long, end long, key long, closed boolean, at int, turned boolean, vertices {_POINT}"))
    places = cut(ranked(chains.select(*within, "start", "end", "key", "closed"), within))
    ids = numbered(places.select(*within, "line").distinct(), within, "line", "line_id")
    ways_round = chains.where("key is not null").select(*within, F.col("key").alias("line"), F.col("turned").alias("back"))
    placed = chains.join(places, [*within, "key"]).join(ids, [*within, "line"]).join(ways_round, [*within, "line"])

    # a ring of several chains begins within its first one: that is cut in two, its front part coming last
    back, v = F.col("back"), F.col("vertices")
    split = F.col("at") + 1 + back.cast("int")  # the vertex at which the line begins
    forward = F.when(back, F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq"))
    whole = F.array(F.struct(forward.alias("seq"), F.when(back, F.reverse(v)).otherwise(v).alias("vertices")))
    front, rest = F.slice(v, F.lit(1), split), F.slice(v, split, F.size(v) - split + 1)
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.when(back, F.reverse(front)).otherwise(rest).alias("vertices")),
        F.struct(F.col("n").alias("seq"), F.when(back, F.reverse(rest)).otherwise(front).alias("vertices")),
    )
    # in a ring the first chain is the cut one, so that of a line run backwards the others follow in falling order
    others = F.array(F.struct(F.when(back, F.col("n") - F.col("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse(v)).otherwise(v).alias("vertices")))
    pieces = F.when(~F.col("ring"), whole).when(F.col("seq") > 0, others).otherwise(F.filter(halves, lambda h: F.size(h["vertices"]) > 1))
    out = placed.select(*within, (F.col("line_id") - 1).alias("line_id"), F.col("ring").alias("closed"), F.explode(pieces).alias("piece"))
    return out.select(*within, "line_id", F.col("piece.seq").alias("seq"), "closed", F.col("piece.vertices").alias("vertices"))


def contour_lines(cells: DataFrame, grid: Grid, interval: float, base: float = 0.0, tile: int = TILE) -> DataFrame:
    """(raster_id, level, line_id, vertices): contour_chains() with each line in one row; closed lines repeat their first vertex."""
    pieces = contour_chains(cells, grid, interval, base, tile).withColumn("rest", F.slice("vertices", F.lit(2), F.size("vertices")))
    lines = pieces.groupBy("raster_id", "level", "line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "vertices", "rest"))).alias("p"))
    first, later = F.element_at("p", 1)["vertices"], F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["rest"])
    return lines.select("raster_id", "level", "line_id", F.concat(first, F.flatten(later)).alias("vertices"))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each of them reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _tile_regions(table: pa.Table) -> pa.Table:
    """The smallest cell id of each 4-connected region of equal values within a tile, by links of neighbouring runs."""
    table = table.sort_by([("row", "ascending"), ("col", "ascending")])
    row, col, value, ids = (table[c].to_numpy() for c in ("row", "col", "value", "id"))
    row, col = row - row.min(), col - col.min()
    begins = np.append(True, (np.diff(row) != 0) | (np.diff(col) != 1) | (np.diff(value) != 0))
    run = np.cumsum(begins) - 1
    at = np.full((row.max() + 1, col.max() + 1), -1)
    at[row, col] = np.arange(len(row))
    above, below = at[:-1].ravel(), at[1:].ravel()
    both = (above >= 0) & (below >= 0)
    above, below = above[both], below[both]
    same = value[above] == value[below]
    root = _joined(run[-1] + 1, run[above[same]], run[below[same]])
    part = ids[np.flatnonzero(begins)][root[run]]  # runs are in the order of ids
    return table.select(["raster_id", "row", "col", "value", "id"]).append_column("part", pa.array(part))


def label_regions(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(raster_id, row, col, value, id, region): region is the smallest cell id of its 4-connected equal values.

    Regions are found within tiles first; only parts that touch across tile borders are then
    walked, by least labels and pointer jumping.
    """
    ship(cells.sparkSession)
    have = cells.where(F.col("value").isNotNull()).select("raster_id", "row", "col", F.col("value").cast("double").alias("value"), (F.col("row").cast("long") * grid.width + F.col("col")).alias("id"))
    tiled = have.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    parts = cut(tiled.groupBy("raster_id", "tr", "tc").applyInArrow(_tile_regions, "raster_id string, row int, col int, value double, id long, part long"))
    links = None
    for axis, other in (("row", "col"), ("col", "row")):
        low = parts.where(F.col(axis) % tile == tile - 1).select("raster_id", F.col(other).alias("o"), (F.col(axis) + 1).alias("at"), "value", F.col("part").alias("a"))
        high = parts.where((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select("raster_id", F.col(other).alias("o"), F.col(axis).alias("at"), "value", F.col("part").alias("b"))
        pair = low.join(high, ["raster_id", "o", "at", "value"]).select("raster_id", "a", "b")
        links = pair if links is None else links.union(pair)
    both = cut(links.union(links.select("raster_id", "b", "a")).distinct())
    labels = cut(both.groupBy("raster_id", F.col("a").alias("part")).agg(F.least(F.first("a"), F.min("b")).alias("region")))
    while True:
        near = both.join(labels.withColumnRenamed("part", "b"), ["raster_id", "b"]).groupBy("raster_id", F.col("a").alias("part")).agg(F.min("region").alias("near"))
        low = labels.join(near, ["raster_id", "part"]).select("raster_id", "part", "region", F.least("region", "near").alias("low"))
        jump = labels.select("raster_id", F.col("part").alias("low"), F.col("region").alias("jump"))
        after = cut(low.join(jump, ["raster_id", "low"], "left").select("raster_id", "part", F.least("low", F.coalesce("jump", "low")).alias("region"), F.col("region").alias("was")))
        labels = after.select("raster_id", "part", "region")
        if after.where("region < was").limit(1).count() == 0:
            break
    return parts.join(labels, ["raster_id", "part"], "left").select("raster_id", "row", "col", "value", "id", F.coalesce("region", "part").alias("region"))


#: Sides of a cell in the order of tracing, each by the step across it, the step along it and its first corner.
_ACROSS, _ALONG, _CORNER = ((-1, 0), (0, 1), (1, 0), (0, -1)), ((0, 1), (1, 0), (0, -1), (-1, 0)), ((0, 0), (0, 1), (1, 1), (1, 0))


def _tile_rings(grid: Grid, tile: int):
    """Chains of a tile's sides between regions, from its cells and those around it.

    Sides run with their region to the right. Where the cell ahead lacks the region a side is
    followed by the next one of its own cell, where the one ahead across the side has it too by
    that one's, so at a corner where two lobes touch each keeps its own ring.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raster, tr, tc = (k.as_py() for k in key)
        r, c = table["row"].to_numpy() - tr * tile + 1, table["col"].to_numpy() - tc * tile + 1
        regions, values = np.full((tile + 2, tile + 2), -1, np.int64), np.zeros((tile + 2, tile + 2))
        regions[r, c], values[r, c] = table["region"].to_numpy(), table["value"].to_numpy()
        own = np.zeros((tile + 2, tile + 2), bool)
        own[1:-1, 1:-1] = regions[1:-1, 1:-1] >= 0
        rows, cols, sides = [], [], []
        for k, (dr, dc) in enumerate(_ACROSS):
            y, x = np.nonzero(own & (regions != np.roll(regions, (-dr, -dc), (0, 1))))
            rows, cols, sides = [*rows, y], [*cols, x], [*sides, np.full(len(y), k)]
        y, x, k = np.concatenate(rows), np.concatenate(cols), np.concatenate(sides)
        across, along, corner = np.array(_ACROSS)[k], np.array(_ALONG)[k], np.array(_CORNER)[k]
        here = regions[y, x]

        def has(step: np.ndarray) -> np.ndarray:
            return regions[y + step[:, 0], x + step[:, 1]] == here

        ahead, beside = has(along), has(along + across)
        straight = has(-along) & ~has(across - along)
        step = np.where(ahead[:, None], along + np.where(beside[:, None], across, 0), 0)
        turn = np.where(~ahead, 1, np.where(beside, 3, 0))
        y, x = y + tr * tile - 1, x + tc * tile - 1
        start = (y * grid.width + x) * 4 + k
        end = ((y + step[:, 0]) * grid.width + x + step[:, 1]) * 4 + (k + turn) % 4
        top, left = y + corner[:, 0], x + corner[:, 1]
        least = (top * (grid.width + 1) + left) * 4 + k
        twice = left * (top + along[:, 0]) - (left + along[:, 1]) * top
        order, heads, closed = local_chains(start, end, least)
        if not len(order):
            return pa.table({f.name: pa.array([], f.type) for f in _CHAIN}, schema=_CHAIN)
        tails = np.append(heads[1:], len(order)) - 1
        low = np.minimum.reduceat(least[order], heads)
        bends = ~straight[order]
        before = np.append(0, np.cumsum(bends))
        first = np.flatnonzero(least[order] == np.repeat(low, tails - heads + 1))
        points = pa.StructArray.from_arrays([pa.array(left[order][bends] * grid.cell_size), pa.array(top[order][bends] * grid.cell_size)], ["x", "y"])
        vertices = pa.ListArray.from_arrays(pa.array(before[np.append(heads, len(order))].astype(np.int32)), points)
        any_of = order[heads]
        return pa.table({
            "raster_id": pa.array([raster] * len(heads), pa.string()), "region": here[any_of], "value": values[y[any_of] - tr * tile + 1, x[any_of] - tc * tile + 1], "start": start[any_of], "end": end[order[tails]],
            "key": low, "closed": pa.array(closed), "at": pa.array((before[first] - before[heads]).astype(np.int32)), "twice": np.add.reduceat(twice[order], heads), "vertices": vertices,
        }).cast(_CHAIN)

    return run


_CHAIN = pa.schema([("raster_id", pa.string()), ("region", pa.int64()), ("value", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.int64()), ("closed", pa.bool_()), ("at", pa.int32()), ("twice", pa.int64()), ("vertices", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])


def region_rings(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(raster_id, region, value, ring, hole, seq, vertices): the rings around regions of equal values, in pieces of a tile at most.

    Vertices are the corners where a ring turns, y down. A ring's pieces follow each other by
    seq and begin with its least (y, x) vertex, which is not repeated at the end. Outer rings
    run clockwise, holes (hole is true) the other way. A region is joined over sides alone and
    its rings keep lobes that touch at a corner apart, so it has one outer ring, which all its
    holes lie in; `ring` numbers rings by their least vertex. No task holds more than a tile
    with the cells around it.
    """
    ship(cells.sparkSession)
    labelled = label_regions(cells, grid, tile).select("raster_id", "row", "col", "value", "region")

    def around(place: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(place) + d) / tile).cast("int") for d in (-1, 0, 1)])))

    dealt = labelled.withColumn("tr", around("row")).withColumn("tc", around("col"))
    chains = cut(dealt.groupBy("raster_id", "tr", "tc").applyInArrow(_tile_rings(grid, tile), f"raster_id string, region long, value double, start long, end long, key long, closed boolean, at int, twice long, vertices {_POINT}"))
    places = cut(ranked(chains.select("raster_id", "start", "end", "key", "closed"), ["raster_id"]))
    placed = chains.join(places, ["raster_id", "key"])
    areas = placed.groupBy("raster_id", "line").agg((F.sum("twice") < 0).alias("hole"))
    v = F.col("vertices")
    halves = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.slice(v, F.col("at") + 1, F.size(v)).alias("vertices")), F.struct(F.col("n").alias("seq"), F.slice(v, F.lit(1), F.col("at")).alias("vertices")))
    pieces = F.when(F.col("seq") == 0, halves).otherwise(F.array(F.struct("seq", "vertices")))
    out = placed.join(areas, ["raster_id", "line"]).select("raster_id", "region", "value", F.col("line").alias("ring"), "hole", F.explode(pieces).alias("piece"))
    return out.select("raster_id", "region", "value", "ring", "hole", "piece.seq", "piece.vertices").where(F.size("vertices") > 0)


def polygonize(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(raster_id, value, region, poly, rings): region_rings() with a region in one row, its outer ring first and then its holes.

    Rings are closed and start at their smallest (y, x) vertex; holes come by that. poly is 0,
    for a region has one outer ring.
    """
    rings = region_rings(cells, grid, tile).groupBy("raster_id", "value", "region", "ring", "hole").agg(F.array_sort(F.collect_list(F.struct("seq", "vertices"))).alias("p"))
    ring = F.flatten(F.transform("p", lambda x: x["vertices"]))
    rings = rings.select("raster_id", "value", "region", "hole", "ring", F.concat(ring, F.slice(ring, F.lit(1), F.lit(1))).alias("shape"))
    regions = rings.groupBy("raster_id", "value", "region").agg(F.array_sort(F.collect_list(F.struct("hole", "ring", "shape"))).alias("r"))
    return regions.select("raster_id", "value", "region", F.lit(0).alias("poly"), F.transform("r", lambda x: x["shape"]).alias("rings"))


def rasterize(polygons: DataFrame, grid: Grid, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Cells whose centres lie in a polygon (poly_ord, value, rings), by even-odd spans; the last polygon wins.

    An edge is copied to the scan rows that it crosses and a span to its cells, so nothing is
    compared with everything. Without area in the box or the grid there is no data.
    """
    from gridweft.functions.grid import blank

    frame = blank(polygons.sparkSession, grid)
    xmin, ymin, xmax, ymax = bbox
    if not grid.width or not grid.height or xmax <= xmin or ymax <= ymin:
        return frame
    w, h = (xmax - xmin) / grid.width, (ymax - ymin) / grid.height
    rings = polygons.select("poly_ord", "value", F.explode("rings").alias("ring"))
    edges = rings.select("poly_ord", "value", F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))).alias("e"))
    edges = edges.select("poly_ord", "value", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("y1 <> y2")
    top = F.floor((ymax - F.greatest("y1", "y2")) / h - 0.5).cast("int")
    bottom = F.ceil((ymax - F.least("y1", "y2")) / h - 0.5).cast("int")
    edges = edges.withColumn("lo", F.greatest(top, F.lit(0))).withColumn("hi", F.least(bottom, F.lit(grid.height - 1))).where("lo <= hi")
    scans = edges.withColumn("row", F.explode(F.sequence("lo", "hi"))).withColumn("y", F.lit(ymax) - (F.col("row") + 0.5) * h)
    scans = scans.where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    scans = scans.withColumn("x", F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    crossed = scans.groupBy("poly_ord", "value", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = crossed.where("size(xs) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))))
    spans = pairs.withColumn("first", F.greatest(F.ceil((F.element_at("xs", F.col("k")) - xmin) / w - 0.5), F.lit(0)).cast("int")).withColumn("last", F.least(F.floor((F.element_at("xs", F.col("k") + 1) - xmin) / w - 0.5), F.lit(grid.width - 1)).cast("int")).where("first <= last")
    covered = spans.withColumn("col", F.explode(F.sequence("first", "last"))).groupBy("row", "col").agg(F.max(F.struct("poly_ord", "value")).alias("top"))
    return frame.drop("value").join(covered, ["row", "col"], "left").select("raster_id", "row", "col", F.col("top.value").alias("value"))
