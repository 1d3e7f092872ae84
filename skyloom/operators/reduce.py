"""Per-pixel reducers over observation tables.

An observation is a row (pixel keys, rank, bands): what one scene shows at one
pixel, already masked.  Every reducer is one aggregation, hence one shuffle on
the pixel; the stack of a pixel is as long as the scenes that cover it, never as
long as the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_valid(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Drop observations that are zero in all bands; with one band zero is data."""
    if len(bands) < 2:
        return obs
    return obs.where(fold(lambda a, b: a | b, [F.col(b) != 0 for b in bands]))


def cap_observations(obs: DataFrame, pixel: Sequence[str], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` observations of each pixel in rank order."""
    order = Window.partitionBy(*pixel).orderBy(rank)
    return obs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k")


def stop_tiles(obs: DataFrame, covered: DataFrame, pixel: Sequence[str], tile: Sequence[str], least: int, rank: str = "rank") -> DataFrame:
    """Tile-scoped early stop: scenes are used in rank order until every covered
    pixel of the tile has ``least`` observations; all of them if one never has.

    ``covered`` has the pixel and tile columns of every pixel to be filled.
    ``obs`` has the pixel and tile columns too.
    """
    kth = F.get(F.array_sort(F.collect_list(rank)), F.lit(least - 1))
    per_pixel = obs.groupBy(*pixel).agg(kth.alias("_kr"))
    cut = covered.select(*pixel, *tile).join(per_pixel, list(pixel), "left").groupBy(*tile).agg(F.when(F.count("_kr") == F.count(F.lit(1)), F.max("_kr")).alias("_cut"))
    return obs.join(cut, list(tile)).where(F.col("_cut").isNull() | (F.col(rank) <= F.col("_cut"))).drop("_cut")


def count_observations(obs: DataFrame, pixel: Sequence[str]) -> DataFrame:
    return obs.groupBy(*pixel).agg(F.count(F.lit(1)).alias("n"))


def mean(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Integer mean (floor of sum by count) of every band, and the count."""
    return obs.groupBy(*pixel).agg(*[F.expr(f"sum({b}) div count(1)").alias(b) for b in bands], F.count(F.lit(1)).alias("n"))


def first(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], rank: str = "rank") -> DataFrame:
    """All bands of the valid observation of lowest rank."""
    # by band, so that the buffers are plain longs and the aggregation hashes; a rank is unique in its pixel
    best = obs.groupBy(*pixel).agg(*[F.min_by(b, rank).alias(b) for b in bands])
    return best.select(*pixel, *bands, F.lit(1).cast("bigint").alias("n"))


def _percentile_of(values: Column, percentile: float) -> Column:
    """Linear interpolation in single precision, truncated; ``values`` is sorted."""
    position = (F.lit(percentile / 100).cast("float") * (F.size(values) - 1).cast("float")).cast("float")
    low, high = F.get(values, F.floor(position).cast("int")), F.get(values, F.ceil(position).cast("int"))
    part = position.cast("double") - F.floor(position)
    return F.floor((low.cast("double") + (high - low).cast("double") * part).cast("float")).cast("bigint")


def percentile(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], q: float) -> DataFrame:
    """Percentile ``q`` of every band, band by band, and the count."""
    stacks = obs.groupBy(*pixel).agg(*[F.array_sort(F.collect_list(b)).alias(b) for b in bands], F.count(F.lit(1)).alias("n"))
    return stacks.select(*pixel, *[_percentile_of(F.col(b), q).alias(b) for b in bands], "n")


def median(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    return percentile(obs, pixel, bands, 50.0)


def medoid(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], rank: str = "rank") -> DataFrame:
    """The observed spectrum nearest the per-band median, ties to the lowest rank.

    Distances use doubled medians, so they stay whole numbers.
    """
    stacks = obs.groupBy(*pixel).agg(F.collect_list(F.struct(F.col(rank).alias("r"), *bands)).alias("_s"), *[F.array_sort(F.collect_list(b)).alias(f"_{b}") for b in bands], F.count(F.lit(1)).alias("n"))
    doubled = [(F.get(f"_{b}", F.floor((F.size(f"_{b}") - 1) / 2).cast("int")) + F.get(f"_{b}", F.floor(F.size(f"_{b}") / 2).cast("int"))).alias(f"_t_{b}") for b in bands]
    targets = stacks.select(*pixel, "_s", "n", *doubled)

    def scored(s: Column) -> Column:
        distance = fold(lambda a, b: a + b, [(2 * s[b] - F.col(f"_t_{b}")) * (2 * s[b] - F.col(f"_t_{b}")) for b in bands])
        return F.struct(distance.alias("d"), s["r"].alias("r"), *[s[b].alias(b) for b in bands])

    best = targets.select(*pixel, F.array_min(F.transform("_s", scored)).alias("_o"), "n")
    return best.select(*pixel, *[F.col(f"_o.{b}").alias(b) for b in bands], "n")


def mosaic(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], method: str, *, percentile_q: float | None = None, rank: str = "rank", max_observations: int | None = None, zero_is_missing: bool = True) -> DataFrame:
    """Any method by name, after the all-zero rule (if it holds) and the cap."""
    obs = source_valid(obs, bands) if zero_is_missing else obs
    if max_observations is not None and method != "first":
        obs = cap_observations(obs, pixel, max_observations, rank)
    if method == "mean":
        return mean(obs, pixel, bands)
    if method == "first":
        return first(obs, pixel, bands, rank)
    if method == "median":
        return median(obs, pixel, bands)
    if method == "percentile":
        return percentile(obs, pixel, bands, float(percentile_q))
    if method == "medoid":
        return medoid(obs, pixel, bands, rank)
    raise ValueError(f"Invalid mosaic method: {method}. Must be of mean, first, percentile, median, medoid")


def finish(filled: DataFrame, grid: DataFrame, pixel: Sequence[str], bands: Sequence[str], most: int = 65535) -> DataFrame:
    """Every pixel of the grid: unobserved zero, values clipped to the type, validity 255 or 0."""
    done = grid.select(*pixel).join(filled, list(pixel), "left")
    out = [F.floor(F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(b, F.lit(0))))).cast("bigint").alias(b) for b in bands]
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return done.select(*pixel, *out, n.alias("n"), F.when(n > 0, 255).otherwise(0).cast("bigint").alias("valid"))
