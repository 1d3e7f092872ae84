"""Footprint overlap counts, frequent coverage, and polygon burns."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.geotiff import Grid
from .masks import away_from

Ring = list[tuple[float, float]]


def inside(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd rule for a point and a fixed ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = F.lit(float(x2 - x1)) * (y - float(y1)) / F.lit(float(y2 - y1)) + float(x1)
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def _segment_meets_cell(x0: Column, y0: Column, x1: Column, y1: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Whether a segment meets a closed cell: boxes overlap and the corners are not all on one side."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    box = (x1 >= min(a[0], b[0])) & (x0 <= max(a[0], b[0])) & (y1 >= min(a[1], b[1])) & (y0 <= max(a[1], b[1]))
    sides = [F.lit(float(dx)) * (y - a[1]) - F.lit(float(dy)) * (x - a[0]) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    return box & ~((sides[0] > 0) & (sides[1] > 0) & (sides[2] > 0) & (sides[3] > 0)) & ~((sides[0] < 0) & (sides[1] < 0) & (sides[2] < 0) & (sides[3] < 0))


def burn_center(pixels: DataFrame, ring: Ring, row: str = "row", col: str = "col") -> DataFrame:
    """Pixels whose centre is inside the ring (pixel coordinates)."""
    return pixels.where(inside(F.col(col) + 0.5, F.col(row) + 0.5, ring))


def burn_touched(pixels: DataFrame, ring: Ring, row: str = "row", col: str = "col") -> DataFrame:
    """Pixels that the ring's area or boundary touches."""
    x0, y0 = F.col(col).cast("double"), F.col(row).cast("double")
    meets = inside(x0 + 0.5, y0 + 0.5, ring)
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        meets = meets | _segment_meets_cell(x0, y0, x0 + 1.0, y0 + 1.0, a, b)
    return pixels.where(meets)


def overlap_count(grid: DataFrame, boxes: DataFrame) -> DataFrame:
    """row, col, n: how many boxes (x0, y0, x1, y1 in pixels, half open) hold the pixel's centre.

    Boxes are spread to the rows and columns that they cover, so the join is on
    pixel keys, not a comparison of every box with every pixel.
    """
    first_r, last_r = F.ceil(F.col("y0") - 0.5), F.ceil(F.col("y1") - 0.5) - 1
    first_c, last_c = F.ceil(F.col("x0") - 0.5), F.ceil(F.col("x1") - 0.5) - 1
    rows = boxes.where((last_r >= first_r) & (last_c >= first_c)).select("*", F.explode(F.sequence(first_r, last_r)).alias("row"))
    cells = rows.select("row", F.explode(F.sequence(first_c, last_c)).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return grid.select("row", "col").join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def polygons(kind: str | None, coordinates: str | None) -> list[list[Ring]]:
    """Polygons (lists of rings) of a GeoJSON geometry; none: an empty list."""
    if not coordinates or kind not in ("Polygon", "MultiPolygon"):
        return []
    found = json.loads(coordinates)
    return [[[(p[0], p[1]) for p in ring] for ring in one] for one in ([found] if kind == "Polygon" else found)]


def row_spans(shape: list[list[Ring]], height: int, width: int) -> Iterator[tuple[int, int, int]]:
    """row, first and last column of the pixels whose centres are in any of the polygons (pixel coordinates)."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for rings in shape:
        edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[1] != b[1]]
        ys = [p[1] for e in edges for p in e]
        for row in range(max(0, math.ceil(min(ys, default=0) - 0.5)), min(height, math.ceil(max(ys, default=0) - 0.5))):
            y = row + 0.5
            at = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in edges if (a[1] > y) != (b[1] > y))
            for x0, x1 in zip(at[::2], at[1::2], strict=True):
                first, last = max(0, math.ceil(x0 - 0.5)), min(width, math.ceil(x1 - 0.5)) - 1
                if first <= last:
                    rows.setdefault(row, []).append((first, last))
    for row, parts in rows.items():
        end = -1
        for first, last in sorted(parts):
            if last > end:
                yield row, max(first, end + 1), last
                end = last


def footprint_count(grid: DataFrame, scenes: DataFrame, place: Grid) -> DataFrame:
    """row, col, n: how many footprints in degrees hold the pixel's centre.

    ``scenes`` has geometry (type, coordinates in JSON; null: not counted), or else
    x0, y0, x1, y1; footprints are projected to ``place``, the pixels' grid.
    """
    known = "geometry" in scenes.columns
    source = scenes.select("geometry.type", "geometry.coordinates") if known else scenes.select(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])

    def pixel(p: tuple[float, float]) -> tuple[float, float]:
        x, y = geo.project(p[0], p[1], place.epsg)
        return (x - place.minx) / place.res, (place.maxy - y) / place.res

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shape = polygons(*values) if known else [] if None in values else [[geo.densify(values)]]
                spans = list(row_spans([[[pixel(p) for p in ring] for ring in rings] for rings in shape], place.height, place.width))
                yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], ["row", "first", "last"])

    spans = source.mapInArrow(run, "row bigint, first bigint, last bigint")
    cells = spans.select("row", F.explode(F.sequence("first", "last")).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return grid.select("row", "col").join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def frequent(counts: DataFrame, fraction: float, steps: int = 4) -> DataFrame:
    """Pixels with at least ``fraction`` of the largest count, and not near one with less."""
    top = counts.agg(F.max("n").alias("_top"))
    rated = counts.crossJoin(F.broadcast(top)).withColumn("ok", (F.col("_top") > 0) & (F.col("n") >= F.col("_top") * F.lit(float(fraction))))
    return away_from(rated.where("ok").select("row", "col"), rated.where("not ok").select("row", "col"), [], "row", "col", steps)
