"""Per-cell reductions of stacks (raster_id, row, col, value, t_idx, t): one shuffle by cell each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions.grid import CELL, InvalidInput

COMPOSITES = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "stddev": F.stddev_pop}


def composite(layers: DataFrame, method: str = "mean") -> DataFrame:
    """The mean, median, max, min or population deviation of each cell's data over the layers."""
    if method not in COMPOSITES:
        raise InvalidInput(f"unknown composite {method!r}")
    return layers.groupBy(*CELL).agg(COMPOSITES[method]("value").alias("value"))


def linear_trend(layers: DataFrame) -> DataFrame:
    """(slope, intercept, r_squared) of values over t by least squares.

    No data from fewer than two values or one time only; values that are all equal have r_squared 0.
    """
    v = F.col("value")
    t = F.when(v.isNotNull(), F.col("t"))
    fitted = layers.groupBy(*CELL).agg(
        F.count(v).alias("n"), F.var_pop(t).alias("vt"), F.var_pop(v).alias("vv"), F.covar_pop(v, t).alias("c"), F.avg(t).alias("mt"), F.avg(v).alias("mv")
    )
    usable = (F.col("n") >= 2) & (F.col("vt") * F.col("n") * F.col("n") >= 1e-15)
    slope = F.try_divide(F.col("c"), F.col("vt"))
    r2 = F.when(F.col("vv") == 0, 0.0).otherwise(F.try_divide(F.col("c") * F.col("c"), F.col("vt") * F.col("vv")))
    return fitted.select(*CELL, F.when(usable, slope).alias("slope"), F.when(usable, F.col("mv") - slope * F.col("mt")).alias("intercept"), F.when(usable, r2).alias("r_squared"))


def change_detection(layers: DataFrame, threshold: float, n_layers: int) -> DataFrame:
    """(magnitude, changed): |last - first| by layer index and 1 where it reaches the threshold, else 0."""
    first, last = (F.max(F.when(F.col("t_idx") == k, F.col("value"))) for k in (0, n_layers - 1))
    size = F.abs(F.col("last") - F.col("first"))
    return layers.groupBy(*CELL).agg(first.alias("first"), last.alias("last")).select(*CELL, size.alias("magnitude"), F.when(size.isNotNull(), F.when(size >= threshold, 1.0).otherwise(0.0)).alias("changed"))


def anomaly_zscore(layers: DataFrame, n_layers: int) -> DataFrame:
    """Deviations of the last layer from the mean of those before it; 0 where these don't vary.

    No data from fewer than three layers, fewer than two earlier values or no last one.
    """
    before = F.when(F.col("t_idx") < n_layers - 1, F.col("value"))
    now = F.max(F.when(F.col("t_idx") == n_layers - 1, F.col("value")))
    base = layers.groupBy(*CELL).agg(F.count(before).alias("n"), F.avg(before).alias("m"), F.stddev_pop(before).alias("s"), now.alias("now"))
    score = F.when(F.col("s") <= 1e-10, 0.0).otherwise((F.col("now") - F.col("m")) / F.col("s"))
    usable = (F.col("n") >= 2) & F.col("now").isNotNull() & F.lit(n_layers >= 3)
    return base.select(*CELL, F.when(usable, score).alias("value"))


def phenology(layers: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(start_of_season, peak, end_of_season, max_value) in times t.

    The threshold is the least value plus a fraction of the amplitude; the start is the first
    value before the peak that reaches it, the end the first after the peak below it. The peak
    is the last of equal greatest values. No data from fewer than three values or no amplitude.
    """
    item = F.struct("t_idx", "t", F.col("value").alias("v"))
    cells = layers.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), item))).alias("s"), F.min("value").alias("lo"), F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), "t_idx", "t"))).alias("top"))
    usable = (F.size("s") >= 3) & (F.col("top.v") - F.col("lo") >= 1e-10)
    level = F.col("lo") + (F.col("top.v") - F.col("lo")) * fraction
    cells = cells.withColumn("level", level).withColumn("ok", F.coalesce(usable, F.lit(False)))
    start = F.get(F.filter("s", lambda x: (x["t_idx"] < F.col("top.t_idx")) & (x["v"] >= F.col("level"))), 0)["t"]
    end = F.get(F.filter("s", lambda x: (x["t_idx"] > F.col("top.t_idx")) & (x["v"] < F.col("level"))), 0)["t"]
    return cells.select(*CELL, F.when(F.col("ok"), start).alias("start_of_season"), F.when(F.col("ok"), F.col("top.t")).alias("peak"), F.when(F.col("ok"), end).alias("end_of_season"), F.when(F.col("ok"), F.col("top.v")).alias("max_value"))
