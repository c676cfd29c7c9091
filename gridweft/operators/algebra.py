"""Cell-local map algebra."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import CELL, Grid, InvalidInput, need_same_shape

UNARY = {
    "add": lambda v, c: v + c,
    "multiply": lambda v, c: v * c,
    "sqrt": lambda v, c: F.when(v >= 0, F.sqrt(v)),
    "abs": lambda v, c: F.abs(v),
    "log": lambda v, c: F.when(v > 0, F.ln(v)).when(v == 0, F.lit(float("-inf"))),
}

BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
}


def _named(table: dict, op: str):
    if op not in table:
        raise InvalidInput(f"unknown operation {op!r}")
    return table[op]


def apply_unary(cells: DataFrame, op: str, constant: float = 0.0) -> DataFrame:
    """op of every value: add or multiply a constant, sqrt, abs, log. Roots and logs of negatives are no data."""
    return cells.withColumn("value", _named(UNARY, op)(F.col("value"), F.lit(float(constant))))


def apply_binary(left: DataFrame, right: DataFrame, op: str, left_grid: Grid | None = None, right_grid: Grid | None = None) -> DataFrame:
    """op of the values of equal cells: add, subtract, multiply, divide, min, max. Division by zero is no data."""
    need_same_shape(left_grid, right_grid)
    other = right.select(*CELL, F.col("value").alias("_right"))
    return left.join(other, CELL).withColumn("value", _named(BINARY, op)(F.col("value"), F.col("_right"))).drop("_right")


def expression(cells: DataFrame, column: Column) -> DataFrame:
    """Any column expression over the cells as the new value."""
    return cells.withColumn("value", column.cast("double"))


def reclassify(cells: DataFrame, classes: Iterable[tuple[float, float, float]]) -> DataFrame:
    """The new value of the first class (min, max, new) with min <= value < max; no data outside all."""
    v, out = F.col("value"), None
    for low, high, new in classes:
        here = (v >= low) & (v < high)
        out = F.when(here, F.lit(float(new))) if out is None else out.when(here, F.lit(float(new)))
    return cells.withColumn("value", F.lit(None).cast("double") if out is None else out)


def reclassify_table(cells: DataFrame, classes: DataFrame, bins: int = 1024) -> DataFrame:
    """reclassify() by a table (ord, min, max, new): of the classes that hold a value the one of least ord.

    The span of the finite bounds is cut into bins, one more on either side. A bin keeps the
    first class that covers all of it and those before that one that reach into it, so a class
    has two rows or so however wide it is, and a cell looks through its bin's classes only.
    Ends that are null have no bound on that side; classes with min >= max hold nothing; rows
    without ord or of equal ord come last, by their bounds. No class leaves no data.
    """
    inf = float("inf")
    table = classes.select(F.coalesce(F.col("ord").cast("double"), F.lit(inf)).alias("ord"), F.coalesce(F.col("min").cast("double"), F.lit(-inf)).alias("lo"), F.coalesce(F.col("max").cast("double"), F.lit(inf)).alias("hi"), F.col("new").cast("double").alias("new")).where("lo < hi")
    ends = table.select(F.explode(F.array("lo", "hi")).alias("x")).where(F.abs("x") < inf)
    low, high = ends.agg(F.min("x"), F.max("x")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    step = (high / bins - low / bins) or 1.0

    def bin_of(x: Column) -> Column:
        return F.when(x < low, -1).when(x >= high, bins).otherwise(F.least(F.floor((x - low) / step), F.lit(bins - 1))).cast("int")

    each = table.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    # whole: no end of the class lies in the bin; bins are told by the same formula as cells
    whole = ((bin_of(F.col("lo")) < F.col("bin")) | (F.col("lo") == -inf)) & ((bin_of(F.col("hi")) > F.col("bin")) | (F.col("hi") == inf))
    row = F.struct("ord", "lo", "hi", "new")
    first = each.where(whole).groupBy("bin").agg(F.min(row).alias("first"))
    held = each.where(~whole).join(first, "bin", "left").where(F.col("first").isNull() | (row < F.col("first"))).select("bin", row.alias("class"))
    held = held.union(first.select("bin", "first")).groupBy("bin").agg(F.array_sort(F.collect_set("class")).alias("_classes"))
    v = F.col("value")
    found = F.try_element_at(F.filter("_classes", lambda c: (v >= c["lo"]) & (v < c["hi"])), F.lit(1))["new"]
    tagged = cells.withColumn("_bin", bin_of(v)).join(F.broadcast(held.withColumnRenamed("bin", "_bin")), "_bin", "left")  # bins + 2 rows
    return tagged.withColumn("value", found).select(*cells.columns)


def normalized_difference(a: DataFrame, b: DataFrame, eps: float = 1e-10, keys: Iterable[str] = ()) -> DataFrame:
    """(a - b) / (a + b) of equal cells, and of equal `keys` such as t_idx; no data where |a + b| <= eps.

    With eps=0 only sums of exactly zero are no data.
    """
    on = [*CELL, *keys]
    other = b.select(*on, F.col("value").alias("_b"))
    total = F.col("value") + F.col("_b")
    return a.join(other, on).withColumn("value", F.when(F.abs(total) > eps, (F.col("value") - F.col("_b")) / total)).drop("_b")
