"""Statistics of values by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweft.functions.grid import CELL, DimensionMismatch, Grid, need_same_shape
from gridweft.functions.rounds import cut

#: A zone of more cells than this has its median found by counting, not by gathering its values.
HOT_CELLS = 1_000_000
_BUCKETS = 4096
_ZONE = ["raster_id", "zone"]


def _selected(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(raster_id, zone, which, value): of each zone the k-th smallest value, k from 1, by counts of buckets.

    `wanted` has (raster_id, zone, which, k, lo, hi) with the zone's least and greatest value.
    Each round cuts the span from lo to hi into equal buckets, counts them (combined before the
    shuffle) and goes on with the one that holds the k-th value, between its own least and
    greatest. Both lie in different buckets while they differ, so a span of doubles is used up
    in a few rounds, and no task sees the values of a zone.
    """
    while True:
        open_ = wanted.where("lo < hi")
        if open_.limit(1).count() == 0:
            return wanted.select(*_ZONE, "which", F.col("lo").alias("value"))
        inside = values.join(open_, _ZONE).where(F.col("value").between(F.col("lo"), F.col("hi")))
        share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, for spans beyond the greatest double
        counted = inside.withColumn("bucket", F.least(F.floor(share * _BUCKETS), F.lit(_BUCKETS - 1))).groupBy(*_ZONE, "which", "k", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*_ZONE, "which").orderBy("bucket")))  # _BUCKETS rows at most
        there = upto.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        there = there.select(*_ZONE, "which", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi")
        wanted = cut(there.unionByName(wanted.where("lo >= hi")))


def zonal_stats(values: DataFrame, zones: DataFrame, value_grid: Grid | None = None, zone_grid: Grid | None = None, hot_cells: int = HOT_CELLS) -> DataFrame:
    """(raster_id, zone, count, min, max, mean, sum, std, median) of the cells with data in both, by zone label.

    All but the median is combined before the shuffle. Zones of over hot_cells cells, of which
    there are no more than cells / hot_cells, have their medians found by _selected().
    """
    need_same_shape(value_grid, zone_grid, DimensionMismatch)
    labels = zones.select(*CELL, F.col("value").alias("zone"))
    both = values.join(labels, CELL).where(F.col("value").isNotNull() & F.col("zone").isNotNull())
    v = "value"
    plain = [F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.stddev_pop(v).alias("std")]
    both = both.select(*_ZONE, v)
    sizes = cut(both.groupBy(*_ZONE).agg(*plain))
    hot = sizes.where(F.col("count") > hot_cells)
    if hot.limit(1).count() == 0:
        medians = both.groupBy(*_ZONE).agg(F.median(v).alias("median"))
        return sizes.join(medians, _ZONE).orderBy(*_ZONE)
    large = F.broadcast(hot.select(*_ZONE))
    medians = both.join(large, _ZONE, "left_anti").groupBy(*_ZONE).agg(F.median(v).alias("median"))
    middle = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.floor((F.col("count") + 1) / 2).alias("k")), F.struct(F.lit(2).alias("which"), (F.floor(F.col("count") / 2) + 1).alias("k"))))
    wanted = cut(hot.select(*_ZONE, "min", "max", middle.alias("m")).select(*_ZONE, "m.which", "m.k", F.col("min").alias("lo"), F.col("max").alias("hi")))
    middles = _selected(cut(both.join(large, _ZONE, "left_semi")), wanted).groupBy(*_ZONE).agg(F.avg("value").alias("median"))
    return sizes.join(medians.unionByName(middles), _ZONE).orderBy(*_ZONE)
