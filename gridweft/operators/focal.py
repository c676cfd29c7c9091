"""Focal statistics over squares and circles.

Each row is summed up first by frames along it, one for each half-width of the window, and
then the rows of the window by lag and lead down the column. Cells are never copied into
their neighbours' windows, so two shuffles of the grid do for every radius. Medians and
majorities, which don't add up, are found in tiles with what lies around them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import InvalidInput, cols_window, rows_window
from gridweft.ship import ship

STATS = ("min", "max", "mean", "sum", "std", "range", "median", "majority")
SHAPES = ("square", "circle")
TILE = 256


def window_offsets(radius: int, shape: str) -> list[tuple[int, int]]:
    """(row, col) steps of the cells of a window."""
    span = range(-radius, radius + 1)
    return [(dr, dc) for dr in span for dc in span if shape == "square" or dr * dr + dc * dc <= radius * radius]


def _middle(ordered: np.ndarray) -> np.ndarray:
    """Medians of rows of sorted values, NaN behind them."""
    n = np.maximum(1, (~np.isnan(ordered)).sum(1))
    at = np.arange(len(ordered))
    return (ordered[at, (n - 1) // 2] + ordered[at, n // 2]) / 2


def _commonest(ordered: np.ndarray) -> np.ndarray:
    """The commonest of each row of sorted values, NaN behind them, the smallest of equally common ones."""
    place = np.arange(ordered.shape[1])
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    run = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    return ordered[np.arange(len(ordered)), np.where(~np.isnan(ordered), run, -1).argmax(1)]


def _ordered_stats(cells: DataFrame, radius: int, shape: str, stat: str, tile: int) -> DataFrame:
    """Medians and majorities, tile by tile: a tile has its cells and those within the radius around it.

    A cell is copied to the few tiles near it and not to its neighbours' windows; numpy sorts
    the windows of some rows at a time, so a task holds a tile and those.
    """
    offsets = window_offsets(radius, shape)
    rows_, cols_ = np.array(offsets).T + radius
    reduce_, others = (_middle if stat == "median" else _commonest), [c for c in cells.columns if c not in ("row", "col", "value")]
    ship(cells.sparkSession)

    def around(place: str) -> Column:
        low, high = F.greatest(F.floor((F.col(place) - radius) / tile), F.lit(0)), F.floor((F.col(place) + radius) / tile)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = key[-2].as_py(), key[-1].as_py()
        r, c = table["row"].to_numpy() - tr * tile + radius, table["col"].to_numpy() - tc * tile + radius
        values = np.full((tile + 2 * radius, tile + 2 * radius), np.nan)
        values[r, c] = table["value"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero((r >= radius) & (r < tile + radius) & (c >= radius) & (c < tile + radius))
        out = np.full(len(own), np.nan)
        have = np.flatnonzero(~np.isnan(values[r[own], c[own]]))
        at_once = max(1, (32 << 20) // (8 * len(offsets)))
        for low in range(0, len(have), at_once):
            some = have[low : low + at_once]
            window = values[(r[own[some]] - radius)[:, None] + rows_, (c[own[some]] - radius)[:, None] + cols_]
            window.sort(axis=1)
            out[some] = reduce_(window)
        result = table.take(pa.array(own)).drop_columns(["value", "_tr", "_tc"])
        return result.append_column("value", pa.array(out, pa.float64(), from_pandas=True)).select(names)

    names = cells.columns
    dealt = cells.withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int")).withColumn("value", F.col("value").cast("double"))
    schema = dealt.schema
    dealt = dealt.withColumn("_tr", around("row")).withColumn("_tc", around("col"))
    by = [c for c in ("raster_id", "band", "t_idx") if c in others]
    return dealt.groupBy(*by, "_tr", "_tc").applyInArrow(run, schema)


def focal_stats(cells: DataFrame, radius: int, shape: str = "square", stat: str = "mean", tile: int = TILE) -> DataFrame:
    """stat of the data in each cell's window, cut at the grid's edges; a cell without data keeps none."""
    if stat not in STATS or shape not in SHAPES or radius < 0:
        raise InvalidInput(f"{stat!r} of a {shape!r} of radius {radius}")
    if stat in ("median", "majority"):
        return _ordered_stats(cells, radius, shape, stat, tile)
    steps = range(-radius, radius + 1)
    half = {dr: radius if shape == "square" else math.isqrt(radius * radius - dr * dr) for dr in steps}
    v = F.col("value")
    parts = {
        "min": {"lo": F.min(v)},
        "max": {"hi": F.max(v)},
        "range": {"lo": F.min(v), "hi": F.max(v)},
        "sum": {"sum": F.sum(v)},
        "mean": {"sum": F.sum(v), "n": F.count(v)},
        "std": {"n": F.count(v), "mean": F.avg(v), "var": F.var_pop(v)},
    }[stat]
    kept, out = cells.columns, cells
    for width in sorted(set(half.values())):
        frame = rows_window().rowsBetween(-width, width)
        for name, part in parts.items():
            out = out.withColumn(f"_{name}{width}", part.over(frame))

    def gathered(name: str) -> list[Column]:
        found = []
        for dr in steps:
            column = f"_{name}{half[dr]}"
            found.append(F.col(column) if dr == 0 else (F.lag(column, -dr) if dr < 0 else F.lead(column, dr)).over(cols_window()))
        return found

    for name in parts:
        for k, column in enumerate(gathered(name)):
            out = out.withColumn(f"_{name}_{k}", column)
    have = {name: [F.col(f"_{name}_{k}") for k in range(len(steps))] for name in parts}

    def least(columns: list[Column]) -> Column:
        return F.least(*columns) if len(columns) > 1 else columns[0]

    def greatest(columns: list[Column]) -> Column:
        return F.greatest(*columns) if len(columns) > 1 else columns[0]

    def total(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])

    if stat == "min":
        value = least(have["lo"])
    elif stat == "max":
        value = greatest(have["hi"])
    elif stat == "range":
        value = greatest(have["hi"]) - least(have["lo"])
    elif stat == "sum":
        value = total(have["sum"])
    elif stat == "mean":
        value = total(have["sum"]) / total(have["n"])
    else:  # rows' variances about the window's mean, which loses no digits to large values
        n = total(have["n"])
        mean = total([a * b for a, b in zip(have["n"], have["mean"], strict=True)]) / n
        value = F.sqrt(total([a * (c + (b - mean) * (b - mean)) for a, b, c in zip(have["n"], have["mean"], have["var"], strict=True)]) / n)
    return out.withColumn("value", F.when(v.isNotNull(), value)).select(*kept)
