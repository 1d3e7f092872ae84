"""Validity masks from scene classes and no-data, as relations of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes that are not clear, and steps of no-data growth.
CLOUDY_CLASSES = (1, 2, 3, 7, 8, 9, 10)
NO_DATA_CLASS = 0
GROWTH = 4


def clear(scl: Column) -> Column:
    return ~scl.isin(*CLOUDY_CLASSES)


def diamond(steps: int) -> list[tuple[int, int]]:
    """Offsets at a city-block distance of at most ``steps``."""
    return [(r, c) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if abs(r) + abs(c) <= steps]


def grow(pixels: DataFrame, scene: Sequence[str], row: str, col: str, steps: int = GROWTH) -> DataFrame:
    """All places within ``steps`` cross dilations of the given pixels."""
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in diamond(steps)])
    spread = pixels.select(*scene, row, col, F.explode(around).alias("_o"))
    return spread.select(*scene, (F.col(row) + F.col("_o.r")).alias(row), (F.col(col) + F.col("_o.c")).alias(col)).distinct()


def away_from(pixels: DataFrame, nodata: DataFrame, scene: Sequence[str], row: str, col: str, steps: int = GROWTH) -> DataFrame:
    """The pixels that no no-data pixel of their scene is near.

    Nothing grows in from outside the raster: only given no-data pixels count.
    """
    return pixels.join(grow(nodata, scene, row, col, steps), [*scene, row, col], "left_anti")


def scl_mask(pixels: DataFrame, scene: Sequence[str], row: str, col: str, scl: str = "scl") -> DataFrame:
    """Pixels that are clear and not near no-data."""
    nodata = pixels.where(F.col(scl) == NO_DATA_CLASS).select(*scene, row, col)
    return away_from(pixels, nodata, scene, row, col).where(clear(F.col(scl)))


def band_mask(pixels: DataFrame, scene: Sequence[str], row: str, col: str, bands: Sequence[str]) -> DataFrame:
    """Pixels that are not near one whose bands sum to zero."""
    total = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    return away_from(pixels, pixels.where(total == 0).select(*scene, row, col), scene, row, col)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti").distinct()


def mask_resolution(resolution: Column, cloud_mask: str) -> Column:
    """Metres of a mask pixel: SCL at least 20, OCM 20 to 50."""
    if cloud_mask == "SCL":
        return F.greatest(resolution, F.lit(20))
    return F.least(F.greatest(resolution, F.lit(20)), F.lit(50))
