"""Reads across UTM zones: every target pixel finds its source pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import FALSE_NORTHING, is_utm, utm_forward, utm_inverse
from ..sources.geotiff import Grid


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """UTM coordinates of one zone and hemisphere in another."""
    if source == target:
        return x, y
    if not (is_utm(source) and is_utm(target)):
        raise ValueError(f"EPSG:{source} to EPSG:{target} is not supported; both must be UTM")
    lon, lat = utm_inverse(x, y - FALSE_NORTHING if source > 32700 else y, F.lit(source % 100))
    east, north = utm_forward(lon, lat, F.lit(target % 100))
    return east, north + FALSE_NORTHING if target > 32700 else north


def source_places(grid: DataFrame, target: Grid, source: Grid) -> DataFrame:
    """``grid`` (row, col) with sr, sc: the source pixel that holds the target pixel's centre."""
    x, y = F.lit(target.minx) + (F.col("col") + 0.5) * target.res, F.lit(target.maxy) - (F.col("row") + 0.5) * target.res
    east, north = reproject(x, y, target.epsg, source.epsg)
    return grid.withColumn("sr", F.floor((F.lit(source.maxy) - north) / source.res)).withColumn("sc", F.floor((east - F.lit(source.minx)) / source.res))


def nearest(grid: DataFrame, target: Grid, pixels: DataFrame, source: Grid, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """keys, row, col, bands of every target pixel whose centre the source holds (others read as nothing)."""
    placed = source_places(grid, target, source).where(F.col("sr").between(0, source.height - 1) & F.col("sc").between(0, source.width - 1))
    given = pixels.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), *bands)
    return placed.join(given, ["sr", "sc"]).select(*keys, "row", "col", *bands)
