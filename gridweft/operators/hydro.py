"""Hydrology over D8 directions and elevations: tiles by themselves, and a graph of their borders between them.

A tile's cells are walked by numpy in the tile's task, and what crosses tiles is a graph of
border cells, which is walked in rounds and is as much smaller as a tile's border is than a
tile. Results go back into the tiles in one more pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridweft.functions.grid import Grid, InvalidInput
from gridweft.functions.rounds import cut, numbered
from gridweft.operators.terrain import D8
from gridweft.ship import ship

TILE = 256


def _id(row: Column, col: Column, grid: Grid) -> Column:
    return row.cast("long") * grid.width + col


def downstream(directions: DataFrame, grid: Grid) -> DataFrame:
    """(raster_id, row, col, value, id, to): the cell that each flows into; NULL where flow ends or leaves the grid."""
    value, dr, dc = F.col("value"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for code, step_r, step_c, _ in D8:
        here = F.abs(value - code) < 0.5
        dr, dc = F.when(here, step_r).otherwise(dr), F.when(here, step_c).otherwise(dc)
    row, col = F.col("row") + dr, F.col("col") + dc
    inside = (row >= 0) & (row < grid.height) & (col >= 0) & (col < grid.width)
    return directions.withColumn("id", _id(F.col("row"), F.col("col"), grid)).withColumn("to", F.when(inside, _id(row, col, grid)))


_TILED = ["raster_id", "tr", "tc"]


def _by_tile(cells: DataFrame, grid: Grid, tile: int, column: str = "id") -> DataFrame:
    """cells with the tile (tr, tc) of a column of cell ids."""
    return cells.withColumn("tr", F.floor(F.col(column) / grid.width / tile).cast("int")).withColumn("tc", F.floor(F.col(column) % grid.width / tile).cast("int"))


class _Tile:
    """The flow graph of a tile's cells: `after` is the place of the cell that each flows into in the tile, or n."""

    def __init__(self, table: pa.Table, width: int, tile: int):
        self.ids, self.to = table["id"].to_numpy(), table["to"].fill_null(-1).to_numpy()
        self.n = len(self.ids)
        row, col = self.ids // width, self.ids % width
        top, left = (row.min() // tile * tile, col.min() // tile * tile) if self.n else (0, 0)
        at = np.full((tile, tile), self.n)
        at[row - top, col - left] = np.arange(self.n)
        r, c = self.to // width - top, self.to % width - left
        inside = (self.to >= 0) & (r >= 0) & (r < tile) & (c >= 0) & (c < tile)
        self.leaves = (self.to >= 0) & ~inside
        self.after = np.full(self.n + 1, self.n)
        self.after[:-1][inside] = at[r[inside], c[inside]]
        row, col = row - top, col - left
        self.border = np.flatnonzero((row == 0) | (col == 0) | (row == tile - 1) | (col == tile - 1))
        self.at = lambda cells: at[cells // width - top, cells % width - left]

    def doubled(self, step: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """step(moving, targets) for pointers that lead 1, 2, 4, ... cells down, until none is left."""
        ahead = self.after.copy()
        for _ in range(max(1, self.n.bit_length()) + 1):
            moving = np.flatnonzero(ahead < self.n)
            if not len(moving):
                return
            step(moving, ahead[moving])
            ahead = ahead[ahead]
        raise InvalidInput("flow directions run in a cycle")

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of the last cell in the tile that each cell's flow reaches, and the steps to it."""
        root, steps = np.arange(self.n), (self.after[:-1] < self.n).astype(np.int64)

        def follow(moving: np.ndarray, targets: np.ndarray) -> None:
            steps[moving] += steps[targets]
            root[moving] = root[targets]

        self.doubled(follow)
        return root, steps

    def gathered(self, own: np.ndarray) -> np.ndarray:
        """Sums of `own` over each cell and all that flows into it in the tile."""
        total = own.astype(np.float64)

        def bring(moving: np.ndarray, targets: np.ndarray) -> None:
            total[:] += np.bincount(targets, weights=total[moving], minlength=self.n)

        self.doubled(bring)
        return total

    def longest(self, own: np.ndarray) -> np.ndarray:
        """The greatest key that reaches each cell, a key gaining _STEP with each cell it flows down."""
        best, reach = own.copy(), 1

        def bring(moving: np.ndarray, targets: np.ndarray) -> None:
            nonlocal reach
            np.maximum.at(best, targets, best[moving] + _STEP * reach)
            reach *= 2

        self.doubled(bring)
        return best


#: A key is 2^40 times the steps from a headwater plus the headwater's cell.
_STEP = 1 << 40


def _flowing(directions: DataFrame, grid: Grid, tile: int) -> DataFrame:
    """Cells with data as (raster_id, tr, tc, id, to)."""
    cells = downstream(directions, grid).where(F.col("value").isNotNull())
    return _by_tile(cells.select("raster_id", "id", "to"), grid, tile)


def _doubled(pointers: DataFrame, grid: Grid, step) -> DataFrame:
    """Applies step(pointers) and halves all paths until no pointer is left; raises on cycles."""
    limit = max(1, grid.width * grid.height).bit_length() + 1
    for _ in range(limit):
        if pointers.where(F.col("to").isNotNull()).limit(1).count() == 0:
            return pointers
        pointers = cut(step(pointers))
    raise InvalidInput("flow directions run in a cycle")


def _borders(cells: DataFrame, grid: Grid, tile: int) -> DataFrame:
    """(raster_id, id, out, n, key, root, steps) of the tiles' border cells.

    out is the cell of another tile that one flows into, n counts the cells of its tile that
    reach it, itself among them, key is the greatest of theirs, and root is the last cell of
    the tile that its own flow reaches, after so many steps.
    """
    width = grid.width

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = _Tile(table, width, tile)
        try:
            root, steps = t.roots()
        except InvalidInput:  # told to the driver, which raises it
            return pa.table({"raster_id": pa.array([key[0].as_py()], pa.string()), **{c: pa.array([-1], pa.int64()) for c in ("id", "out", "n", "key", "root", "steps")}})
        count, longest, at = t.gathered(np.ones(t.n)), t.longest(t.ids.copy()), t.border
        out = pa.array(t.to[at], mask=~t.leaves[at])
        return pa.table({"raster_id": pa.array([key[0].as_py()] * len(at), pa.string()), "id": t.ids[at], "out": out, "n": count[at].astype(np.int64), "key": longest[at], "root": t.ids[root[at]], "steps": steps[at]})

    found = cut(cells.groupBy(*_TILED).applyInArrow(run, "raster_id string, id long, out long, n long, key long, root long, steps long"))
    if found.where("id < 0").limit(1).count():
        raise InvalidInput("flow directions run in a cycle")
    return found


def _links(borders: DataFrame) -> DataFrame:
    """(raster_id, id, out, n, key, entry, root, to, steps) of the cells that flow into another tile.

    root is where that tile's last cell of the flow is, NULL where `out` has no data; to is the
    same if the flow goes on into a further tile, else NULL; steps lead from the cell to root.
    """
    exits = borders.where(F.col("out").isNotNull()).select("raster_id", "id", "out", "n", "key")
    entries = borders.select("raster_id", F.col("id").alias("out"), "root", F.col("steps").alias("inner"))
    on = exits.select("raster_id", F.col("id").alias("root"), F.lit(True).alias("on"))
    linked = exits.join(entries, ["raster_id", "out"], "left").join(on, ["raster_id", "root"], "left")
    return cut(linked.select("raster_id", "id", "out", "n", "key", "root", F.when(F.col("on"), F.col("root")).alias("to"), (F.col("inner") + 1).alias("steps")))


def _moved(pointers: DataFrame, *carried: Column) -> DataFrame:
    """Pointers that lead on, with what their target's pointer leads to as to2, and columns made of both."""
    further = pointers.select("raster_id", F.col("id").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(c + "2") for c in pointers.columns if c not in ("raster_id", "id", "to")])
    moving = pointers.where(F.col("to").isNotNull()).join(further, ["raster_id", "to"])
    return moving.select("raster_id", "id", F.col("to2").alias("to"), *carried)


def flow_accumulation(directions: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """The number of cells upstream of each, itself not counted.

    Each tile counts its own cells. After k rounds a cell that flows into another tile knows
    what comes through fewer than 2^k such cells upstream and its pointer leads past 2^k of
    them; adding what pointers to it bring doubles the reach. What enters a tile is then
    passed down in it.
    """
    ship(directions.sparkSession)
    cells = _flowing(directions, grid, tile)
    links = _links(_borders(cells, grid, tile))

    def step(pointers: DataFrame) -> DataFrame:
        brought = pointers.where(F.col("to").isNotNull()).groupBy("raster_id", F.col("to").alias("id")).agg(F.sum("n").alias("more"))
        ended = pointers.where(F.col("to").isNull()).select("raster_id", "id", "to", "n")  # many, and no key of a join
        return _moved(pointers, F.col("n")).union(ended).join(brought, ["raster_id", "id"], "left").select("raster_id", "id", "to", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))

    through = _doubled(links.select("raster_id", "id", "to", "n"), grid, step).select("raster_id", "id", F.col("n").alias("flow"))
    entering = links.join(through, ["raster_id", "id"]).groupBy("raster_id", F.col("out").alias("id")).agg(F.sum("flow").alias("flow"))
    width = grid.width

    def run(key: tuple, table: pa.Table, more: pa.Table) -> pa.Table:
        t = _Tile(table, width, tile)
        own = np.ones(t.n)
        if t.n and more.num_rows:
            at = t.at(more["id"].to_numpy())
            own[at[at < t.n]] += more["flow"].to_numpy()[at < t.n]
        return pa.table({"raster_id": pa.array([key[0].as_py()] * t.n, pa.string()), "row": (t.ids // width).astype(np.int32), "col": (t.ids % width).astype(np.int32), "value": t.gathered(own) - 1})

    counted = cells.groupBy(*_TILED).cogroup(_by_tile(entering, grid, tile).groupBy(*_TILED)).applyInArrow(run, "raster_id string, row int, col int, value double")
    return counted.unionByName(directions.where(F.col("value").isNull()).select("raster_id", "row", "col", F.lit(None).cast("double").alias("value")))


def outlets(directions: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(raster_id, row, col, id, outlet): the cell where each cell's flow ends."""
    ship(directions.sparkSession)
    cells = _flowing(directions, grid, tile)
    links = _links(_borders(cells, grid, tile))

    def step(pointers: DataFrame) -> DataFrame:
        return _moved(pointers, F.col("outlet2").alias("outlet")).union(pointers.where(F.col("to").isNull()).select("raster_id", "id", "to", "outlet"))

    ends = _doubled(links.select("raster_id", "id", "to", F.coalesce("root", "id").alias("outlet")), grid, step).select("raster_id", "id", "outlet")
    width = grid.width

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        t = _Tile(table, width, tile)
        last = t.ids[t.roots()[0]] if t.n else t.ids
        if known.num_rows and t.n:
            known = known.sort_by("id")
            ids, far = known["id"].to_numpy(), known["outlet"].to_numpy()
            at = np.minimum(np.searchsorted(ids, last), len(ids) - 1)
            last = np.where(ids[at] == last, far[at], last)
        return pa.table({"raster_id": pa.array([key[0].as_py()] * t.n, pa.string()), "row": (t.ids // width).astype(np.int32), "col": (t.ids % width).astype(np.int32), "id": t.ids, "outlet": last})

    return cells.groupBy(*_TILED).cogroup(_by_tile(ends, grid, tile).groupBy(*_TILED)).applyInArrow(run, "raster_id string, row int, col int, id long, outlet long")


def watershed(directions: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """A label for each basin, numbered from 1 in the row-major order of their first cells."""
    ends = cut(outlets(directions, grid, tile))
    firsts = numbered(ends.groupBy("raster_id", "outlet").agg(F.min("id").alias("first")), ["raster_id"], "first", "label")
    labels = ends.join(firsts, ["raster_id", "outlet"]).select("raster_id", "row", "col", F.col("label").cast("double").alias("value"))
    return directions.select("raster_id", "row", "col").join(labels, ["raster_id", "row", "col"], "left")


def _folded(t: _Tile, key: np.ndarray, target: np.ndarray, far_key: np.ndarray, far_order: np.ndarray) -> np.ndarray:
    """Orders of a tile's stream cells, 0 where some cell upstream in another tile is not known yet.

    target, far_key and far_order are of the cells of other tiles that flow into this one. Cells
    are taken by their steps from the farthest headwater, so that all that flows into one is
    known before it; tributaries count in the order of their keys.
    """
    inner = np.flatnonzero(t.after[:-1] < t.n)
    into = np.concatenate([t.after[inner], target])
    by, source = np.concatenate([key[inner], far_key]), np.concatenate([inner, t.n + np.arange(len(target))])
    arrival = np.lexsort((by, into))
    into, source = into[arrival], source[arrival]
    first = np.searchsorted(into, np.arange(t.n + 1))
    many = np.diff(first)
    order = np.concatenate([np.where(many == 0, 1, 0), far_order])
    turn = np.argsort(key >> 40, kind="stable")
    turn = turn[many[turn] > 0]
    steps = key[turn] >> 40
    for some in np.split(turn, np.flatnonzero(np.diff(steps)) + 1) if len(turn) else ():
        reached, known = np.zeros(len(some), np.int64), np.ones(len(some), bool)
        for k in range(many[some].max()):
            has = many[some] > k
            came = order[source[first[some[has]] + k]]
            reached[has] = np.where(came == reached[has], came + 1, np.maximum(came, reached[has]))
            known[has] &= came > 0
        order[some] = np.where(known, reached, 0)
    return order[: t.n]


def stream_order(accumulation: DataFrame, directions: DataFrame, grid: Grid, threshold: float, tile: int = TILE) -> DataFrame:
    """Stream orders of the cells whose accumulation reaches the threshold; others have no data.

    Streams are followed first in, first out from headwaters in row-major order. A tributary of
    the order that its target has reached raises it by one, otherwise the greater stays, so
    orders depend on the sequence in which tributaries arrive. That queue takes cells by their
    steps from the farthest headwater, and those of equal steps by that headwater, the greatest
    of several: a pair that is carried down like a count. With it known, tiles fold their cells,
    in rounds until what flows in from other tiles is known.
    """
    if grid.width * grid.height >= _STEP:
        raise InvalidInput("stream orders of more than 2^40 cells")
    key = ["raster_id", "row", "col"]
    ship(accumulation.sparkSession)
    stream = accumulation.where(F.col("value") >= threshold).select(*key)
    cells = cut(_by_tile(downstream(directions, grid).where(F.col("value").isNotNull()).join(stream, key).select("raster_id", "id", "to"), grid, tile))
    links = _links(_borders(cells, grid, tile))

    def step(pointers: DataFrame) -> DataFrame:
        brought = pointers.where(F.col("to").isNotNull()).groupBy("raster_id", F.col("to").alias("id")).agg(F.max(F.col("key") + F.col("steps") * _STEP).alias("more"))
        ended = pointers.where(F.col("to").isNull()).select("raster_id", "id", "to", "key", "steps")
        moved = _moved(pointers, F.col("key"), (F.col("steps") + F.col("steps2")).alias("steps"))
        return moved.union(ended).join(brought, ["raster_id", "id"], "left").select("raster_id", "id", "to", F.greatest("key", F.coalesce("more", "key")).alias("key"), "steps")

    keys = _doubled(links.select("raster_id", "id", "to", "key", F.coalesce("steps", F.lit(0)).alias("steps")), grid, step).select("raster_id", "id", "key")
    entering = cut(_by_tile(links.select("raster_id", "id", "out").join(keys, ["raster_id", "id"]), grid, tile, "out"))
    width = grid.width

    def run(key: tuple, table: pa.Table, far: pa.Table, everything: bool) -> pa.Table:
        t = _Tile(table, width, tile)
        own = t.ids.copy()
        target = t.at(far["out"].to_numpy()) if t.n else np.empty(0, np.int64)
        here = target < t.n
        target, far_key, far_order = target[here], far["key"].to_numpy()[: len(here)][here], far["order"].to_numpy()[: len(here)][here]
        np.maximum.at(own, target, far_key + _STEP)
        orders = _folded(t, t.longest(own), target, far_key, far_order)
        at = np.arange(t.n) if everything else np.flatnonzero(t.leaves & (orders > 0))
        return pa.table({"raster_id": pa.array([key[0].as_py()] * len(at), pa.string()), "id": t.ids[at], "order": orders[at]})

    def solved(known: DataFrame, everything: bool) -> DataFrame:
        """Orders of cells that flow into other tiles, or of all, from those known so far."""
        far = entering.join(known, ["raster_id", "id"], "left").select(*_TILED, "out", "key", F.coalesce("order", F.lit(0)).cast("long").alias("order"))
        return cells.groupBy(*_TILED).cogroup(far.groupBy(*_TILED)).applyInArrow(lambda k, a, b: run(k, a, b, everything), "raster_id string, id long, order long")

    wanted, known, before = entering.count(), cut(entering.select("raster_id", "id", F.lit(0).cast("long").alias("order")).limit(0)), -1
    while before < (now := known.count()) < wanted:
        known, before = cut(solved(known, False)), now
    orders = solved(known, True)
    places = directions.select(*key, _id(F.col("row"), F.col("col"), grid).alias("id"))
    return places.join(orders, ["raster_id", "id"], "left").select(*key, F.col("order").cast("double").alias("value"))


#: Neighbours of a cell, each pair once.
_PAIRS = ((0, 1), (1, 0), (1, 1), (1, -1))


def _linked(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges make up a least spanning forest, of equal weights the earlier ones: every component takes its least edge, in rounds."""
    order = np.argsort(w, kind="stable")
    a, b = a[order], b[order]
    taken, part, left = np.zeros(len(a), bool), np.arange(n), np.arange(len(a))
    while len(left):
        x, y = part[a[left]], part[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            break
        least = np.full(n, len(a))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        chosen = np.unique(least[least < len(a)])
        taken[chosen] = True
        ends = np.concatenate([part[a[chosen]], part[b[chosen]]]), np.concatenate([part[b[chosen]], part[a[chosen]]])
        root = np.arange(n)
        while True:
            low = np.minimum.reduceat(root[ends[1]][np.argsort(ends[0], kind="stable")], np.flatnonzero(np.append(True, np.diff(np.sort(ends[0])) != 0)))
            after = root.copy()
            at = np.unique(ends[0])
            after[at] = np.minimum(after[at], low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        part = root[part]
    out = np.zeros(len(a), bool)
    out[order[taken]] = True
    return out


def _lowest(level: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least over paths of the greatest edge on the way to a node that has a level, or its level if greater."""
    while len(a):
        after = level.copy()
        np.minimum.at(after, a, np.maximum(w, level[b]))
        np.minimum.at(after, b, np.maximum(w, level[a]))
        if (after == level).all():
            break
        level = after
    return level


class _Basins:
    """A tile's cells by the local minimum that they run down to, and the lowest ways between these basins.

    Cells are compared by value and then by place, so flats run to their first cell. A cell
    drains at the greater of its own value and the level of its basin's minimum.
    """

    def __init__(self, table: pa.Table, grid: Grid, tile: int):
        table = table.filter(table["value"].is_valid())
        row, col, z = (table[c].to_numpy() for c in ("row", "col", "value"))
        self.row, self.col, self.z, self.ids = row, col, z, row.astype(np.int64) * grid.width + col
        n = self.n = len(z)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.ids, z))] = np.arange(n)
        top, left = (row.min() // tile * tile, col.min() // tile * tile) if n else (0, 0)
        self.ranks = np.full((tile + 2, tile + 2), n)
        r, c = row - top + 1, col - left + 1
        self.ranks[r, c] = rank
        low = np.arange(n + 1)
        near = np.minimum.reduce([np.roll(self.ranks, (dr, dc), (0, 1)) for _, dr, dc, _ in D8])
        low[rank] = np.minimum(rank, near[r, c])
        while (low[low] != low).any():
            low = low[low]
        names, basin = np.unique(low[:-1], return_inverse=True)
        self.count, self.basin = len(names), basin[rank]
        height = z[np.lexsort((self.ids, z))]
        a, b, w = [], [], []
        for dr, dc in _PAIRS:
            one, two = self.ranks[1:-1, 1:-1], self.ranks[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc]
            both = (one < n) & (two < n)
            one, two = one[both], two[both]
            apart = basin[one] != basin[two]
            one, two = one[apart], two[apart]
            a, b, w = [*a, basin[one]], [*b, basin[two]], [*w, height[np.maximum(one, two)]]
        a, b, w = (np.concatenate(x) for x in (a, b, w))
        kept = _linked(self.count, a, b, w)
        self.a, self.b, self.w = a[kept], b[kept], w[kept]
        at = (row == 0) | (col == 0) | (row == grid.height - 1) | (col == grid.width - 1)
        self.level = np.full(self.count, np.inf)
        np.minimum.at(self.level, self.basin[at], z[at])
        r, c = r - 1, c - 1
        self.border = np.flatnonzero((r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1))

    def pruned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forest without branches that lead to no border cell and no edge of the grid."""
        wanted = np.isfinite(self.level)
        wanted[self.basin[self.border]] = True
        a, b, w = self.a, self.b, self.w
        while True:
            ends = np.bincount(np.concatenate([a, b]), minlength=self.count)
            stay = ~(((ends[a] == 1) & ~wanted[a]) | ((ends[b] == 1) & ~wanted[b]))
            if stay.all():
                return a, b, w
            a, b, w = a[stay], b[stay], w[stay]


_GRAPH = "raster_id string, tr int, tc int, a array<int>, b array<int>, w array<double>, level array<double>, id array<long>, basin array<int>, z array<double>"


def fill_sinks(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """Raises every cell to the lowest level at which it drains over its eight neighbours to the grid's edge.

    Edge cells keep their value; cells without data neither drain nor are drained; what they
    enclose stays as it is. Tiles find their basins and the lowest ways between them once.
    In rounds the levels of border cells pass into neighbouring tiles, where only the tree of
    ways that lead to a border is walked, until none falls; rounds take in just the tiles
    whose neighbours fell. With the levels around each tile known its cells are raised in one
    more pass.
    """
    ship(cells.sparkSession)
    tiled = cells.withColumn("tr", F.floor(F.col("row") / tile).cast("int")).withColumn("tc", F.floor(F.col("col") / tile).cast("int"))

    columns = to_arrow_schema(StructType.fromDDL(_GRAPH))

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        t = _Basins(table, grid, tile)
        a, b, w = t.pruned()
        at = t.border
        return pa.table({"raster_id": key[:1], "tr": key[1:2], "tc": key[2:], "a": [a.astype(np.int32)], "b": [b.astype(np.int32)], "w": [w], "level": [t.level], "id": [t.ids[at]], "basin": [t.basin[at].astype(np.int32)], "z": [t.z[at]]}).cast(columns)

    graphs = cut(tiled.groupBy(*_TILED).applyInArrow(graph, _GRAPH))

    def levels(key: tuple, table: pa.Table, offers: pa.Table) -> pa.Table:
        """What the border cells drain at, from the tile's graph and what neighbours offer to its border."""
        out = {c: [] for c in ("id", "drain")}
        for row in table.to_pylist():
            a, b, w = np.array(row["a"], np.int64), np.array(row["b"], np.int64), np.array(row["w"], np.float64)
            level, basin, z, ids = np.array(row["level"], np.float64), np.array(row["basin"], np.int64), np.array(row["z"], np.float64), np.array(row["id"], np.int64)
            _offered(level, ids, basin, z, offers)
            drain = np.maximum(z, _lowest(level, a, b, w)[basin])
            some = np.isfinite(drain)
            out = {"id": ids[some], "drain": drain[some]}
        n = len(out["id"])
        return pa.table({"raster_id": pa.array([key[0].as_py()] * n, pa.string()), "tr": pa.array([key[1].as_py()] * n, pa.int32()), "tc": pa.array([key[2].as_py()] * n, pa.int32()), "id": pa.array(out["id"], pa.int64()), "drain": pa.array(out["drain"], pa.float64())})

    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for _, dr, dc, _ in D8])

    def offers_of(state: DataFrame) -> DataFrame:
        """(raster_id, tr, tc, id, drain, fell): the least that cells of other tiles offer to a cell."""
        each = state.select(*_TILED, "id", "drain", "fell", F.explode(around).alias("o"))
        row, col = F.floor(F.col("id") / grid.width) + F.col("o.dr"), F.col("id") % grid.width + F.col("o.dc")
        each = each.select("raster_id", F.col("tr").alias("r0"), F.col("tc").alias("c0"), row.alias("row"), col.alias("col"), "drain", "fell").where((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
        each = each.withColumn("tr", F.floor(F.col("row") / tile).cast("int")).withColumn("tc", F.floor(F.col("col") / tile).cast("int")).where("tr <> r0 or tc <> c0")
        return each.groupBy(*_TILED, (F.col("row") * grid.width + F.col("col")).alias("id")).agg(F.min("drain").alias("drain"), F.max("fell").alias("fell"))

    schema = "raster_id string, tr int, tc int, id long, drain double"
    nothing = cells.sparkSession.createDataFrame([], schema)
    first = graphs.groupBy(*_TILED).cogroup(nothing.groupBy(*_TILED)).applyInArrow(levels, schema)
    state = cut(first.withColumn("fell", F.lit(True)))
    while state.where("fell").limit(1).count():
        offers = cut(offers_of(state))
        active = cut(offers.where("fell").select(*_TILED).distinct())
        now = graphs.join(active, _TILED, "left_semi").groupBy(*_TILED).cogroup(offers.join(active, _TILED, "left_semi").select(*_TILED, "id", "drain").groupBy(*_TILED)).applyInArrow(levels, schema)
        was = state.select("raster_id", "id", F.col("drain").alias("was"))
        now = now.join(was, ["raster_id", "id"], "left").select(*_TILED, "id", "drain", (F.col("was").isNull() | (F.col("drain") < F.col("was"))).alias("fell"))
        rest = state.join(active, _TILED, "left_anti").select(*_TILED, "id", "drain", F.lit(False).alias("fell"))
        state = cut(now.union(rest))

    def fill(key: tuple, table: pa.Table, offers: pa.Table) -> pa.Table:
        t, empty = _Basins(table, grid, tile), table.filter(table["value"].is_null())
        _offered(t.level, t.ids, t.basin, t.z, offers)
        level = _lowest(t.level, t.a, t.b, t.w)[t.basin] if t.n else t.z
        value = np.where(np.isfinite(level), np.maximum(t.z, level), t.z)
        n = t.n + empty.num_rows
        row, col = np.concatenate([t.row, empty["row"].to_numpy()]), np.concatenate([t.col, empty["col"].to_numpy()])
        return pa.table({"raster_id": pa.array([key[0].as_py()] * n, pa.string()), "row": row.astype(np.int32), "col": col.astype(np.int32), "value": pa.array(np.concatenate([value, np.full(empty.num_rows, np.nan)]), pa.float64(), from_pandas=True)})

    last = offers_of(state).select(*_TILED, "id", "drain")
    own = tiled.select(*_TILED, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    return own.groupBy(*_TILED).cogroup(last.groupBy(*_TILED)).applyInArrow(fill, "raster_id string, row int, col int, value double")


def _offered(level: np.ndarray, ids: np.ndarray, basin: np.ndarray, z: np.ndarray, offers: pa.Table) -> None:
    """Lowers the levels of basins to what is offered to their cells, or the cell's value if greater."""
    if not offers.num_rows or not len(ids):
        return
    offers = offers.sort_by("id")
    at, drain = offers["id"].to_numpy(), offers["drain"].to_numpy()
    place = np.minimum(np.searchsorted(at, ids), len(at) - 1)
    met = at[place] == ids
    np.minimum.at(level, basin[met], np.maximum(z[met], drain[place[met]]))
