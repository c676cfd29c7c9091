"""Grids that the registered queries build from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions.grid import CELL, Grid, blank, densify

SALES = Grid(16, 16, cell_size=10.0)
LAYERS = 7
YEARS = [float(1995 + k) for k in range(LAYERS)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities sold by order and part, both modulo 16: whole numbers, so sums don't depend on order."""
    rows = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SALES.height).cast("int").alias("row"), (F.col("l_partkey") % SALES.width).cast("int").alias("col"))
    return rows.agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value")).select(F.lit("0").alias("raster_id"), "row", "col", "value")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales() without data where (7 row + 3 col) mod 11 is 0."""
    return sales(spark, sf_dir).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 != 0, F.col("value")))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a grid: a row a vector, a column a component."""
    rows = _table(spark, sf_dir, "embeddings").select(F.lit("0").alias("raster_id"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


def plane_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """A square grid of about as many cells as there are line items."""
    side = math.isqrt(_table(spark, sf_dir, "lineitem").count())
    return Grid(side, side)


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities sold by order and part, modulo the side of plane_grid(); every cell, 0 where nothing was sold."""
    grid = plane_grid(spark, sf_dir)
    rows = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % grid.height).cast("int").alias("row"), (F.col("l_partkey") % grid.width).cast("int").alias("col"))
    sold = rows.agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("sold"))
    return blank(spark, grid).select(*CELL).join(sold, ["row", "col"], "left").select(*CELL, F.coalesce("sold", F.lit(0.0)).alias("value"))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane() on a slope of 25 a row, so that water runs far over it and stands in pits."""
    return plane(spark, sf_dir).withColumn("value", F.col("value") + F.col("row") * 25.0)


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales() by year of shipping, 1995 to 2001, as layers."""
    rows = _table(spark, sf_dir, "lineitem").where(F.year("l_shipdate").between(1995, 2001))
    rows = rows.groupBy((F.col("l_orderkey") % SALES.height).cast("int").alias("row"), (F.col("l_partkey") % SALES.width).cast("int").alias("col"), (F.year("l_shipdate") - 1995).alias("t_idx"))
    rows = rows.agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    return rows.select(F.lit("0").alias("raster_id"), "row", "col", "t_idx", (F.col("t_idx") + 1995).cast("double").alias("t"), "value")


def bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tax, discount) sums in hundredths as two bands."""
    rows = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SALES.height).cast("int").alias("row"), (F.col("l_partkey") % SALES.width).cast("int").alias("col"))
    both = rows.agg(*[F.sum(F.floor(F.col(c) * 100 + 0.5)).cast("double").alias(c) for c in ("l_tax", "l_discount")])
    return tuple(both.select(F.lit("0").alias("raster_id"), "row", "col", F.col(c).alias("value")) for c in ("l_tax", "l_discount"))


def dense(cells: DataFrame) -> DataFrame:
    return densify(cells, SALES).select(*CELL, "value")


SQL_PLANE = "WITH side AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM lineitem), sold AS (SELECT (l_orderkey % n)::INT AS row, (l_partkey % n)::INT AS col, sum(l_quantity::BIGINT)::DOUBLE AS value FROM lineitem, side GROUP BY ALL), cells AS (SELECT r::INT AS row, c::INT AS col FROM side, range(n) AS a(r), range(n) AS b(c)) SELECT cells.row, cells.col, coalesce(sold.value, 0.0) AS value FROM cells LEFT JOIN sold ON sold.row = cells.row AND sold.col = cells.col"
SQL_GROUND = f"SELECT row, col, value + row * 25.0::DOUBLE AS value FROM ({SQL_PLANE})"
_PLACE = "(l_orderkey % 16)::INT AS row, (l_partkey % 16)::INT AS col"
SQL_SALES = f"SELECT {_PLACE}, sum(l_quantity::BIGINT)::DOUBLE AS value FROM lineitem GROUP BY ALL"
SQL_HOLES = f"SELECT row, col, CASE WHEN (row * 7 + col * 3) % 11 <> 0 THEN value END AS value FROM ({SQL_SALES})"
SQL_SURFACE = "SELECT vec_id::INT AS row, (i - 1)::INT AS col, embedding[i]::DOUBLE AS value FROM embeddings, generate_series(1, 64) AS g(i)"
SQL_YEARS = f"SELECT {_PLACE}, (year(l_shipdate) - 1995)::INT AS t_idx, year(l_shipdate)::DOUBLE AS t, sum(l_quantity::BIGINT)::DOUBLE AS value FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY ALL"
SQL_BANDS = f"SELECT {_PLACE}, sum(floor(l_tax * 100 + 0.5))::DOUBLE AS tax, sum(floor(l_discount * 100 + 0.5))::DOUBLE AS discount FROM lineitem GROUP BY ALL"
