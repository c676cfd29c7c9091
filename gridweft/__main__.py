"""python -m gridweft stats|hillshade: figures of a synthetic plane, as a check of an installation."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridweft.functions.grid import Grid, blank
from gridweft.operators import terrain


def plane(spark: SparkSession, grid: Grid):
    """value = 10 row + 5 col."""
    return blank(spark, grid).withColumn("value", (F.col("row") * 10 + F.col("col") * 5).cast("double"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridweft")
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats")
    stats.add_argument("--width", type=int, default=10)
    stats.add_argument("--height", type=int, default=10)
    shade = commands.add_parser("hillshade")
    shade.add_argument("--azimuth", type=float, default=315.0)
    shade.add_argument("--altitude", type=float, default=45.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridweft").getOrCreate()
    grid = Grid(args.width, args.height) if args.command == "stats" else Grid(10, 10)
    cells = plane(spark, grid)

    def centre(df) -> float | None:
        row = df.where((F.col("row") == grid.height // 2) & (F.col("col") == grid.width // 2)).first()
        return row["value"] if row else None

    def shown(value: float | None) -> str:
        return "no data" if value is None else f"{value:.2f}"

    if args.command == "stats":
        print(f"elevation {shown(centre(cells))} slope {shown(centre(terrain.slope(cells)))} aspect {shown(centre(terrain.aspect(cells)))}")
    else:
        print(f"hillshade {shown(centre(terrain.hillshade(cells, 1.0, args.azimuth, args.altitude)))}")


if __name__ == "__main__":
    main()
