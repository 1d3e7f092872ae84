"""Resampling of pixel relations (scene keys, row, col, bands)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def nearest(grid: DataFrame, source: DataFrame, keys: Sequence[str], height: int, width: int, out_height: int, out_width: int, bands: Sequence[str]) -> DataFrame:
    """Each pixel of ``grid`` (keys, row, col) takes the source pixel at floor(i * source / out); none: zero."""
    wanted = grid.withColumn("sr", F.floor(F.col("row") * height / out_height)).withColumn("sc", F.floor(F.col("col") * width / out_width))
    given = source.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), *bands)
    joined = wanted.join(given, [*keys, "sr", "sc"], "left")
    return joined.select(*keys, "row", "col", *[F.coalesce(b, F.lit(0)).cast("bigint").alias(b) for b in bands])


def average(source: DataFrame, keys: Sequence[str], factor: int, bands: Sequence[str]) -> DataFrame:
    """Mean over blocks of factor by factor source pixels (those present)."""
    cell = source.groupBy(*keys, F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col"))
    return cell.agg(*[(F.sum(b).cast("double") / F.count(b)).alias(b) for b in bands])


def _kernel(name: str, t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    if name == "bilinear":
        return np.maximum(0.0, 1 - a)
    if name == "cubic":
        return np.where(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1, np.where(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2, 0.0))
    x = np.maximum(a, 1e-12) * math.pi
    return np.where(a < 1e-12, 1.0, np.where(a < 3, 3 * np.sin(x) * np.sin(x / 3) / (x * x), 0.0))


_REACH = {"bilinear": 1, "cubic": 2, "lanczos": 3}
#: Side of a square of source pixels or, where there are more of these, of pixels made, that one task works on at once, about.
SIDE = 128


def convolve(grid: DataFrame, source: DataFrame, keys: Sequence[str], scale: float, method: str, bands: Sequence[str]) -> DataFrame:
    """Weighted taps around the source place of each pixel's centre; weights of
    missing taps are left out and the rest made to sum to one.

    ``scale``: source pixels of one pixel of ``grid``.  Where that is more than one,
    the kernel is as many times wider, so that every source pixel has its part.
    Both tables are dealt by squares, source pixels to all squares that they reach into; a weight
    is that of the row times that of the column, so a square is two products of matrices.
    """
    if method not in _REACH:
        raise ValueError(f"Invalid resampling method: {method}")
    scale = float(scale)
    wide = max(1.0, scale)
    reach = math.ceil(_REACH[method] * wide)
    side = max(1, int(SIDE // wide))
    square = ["_r", "_c"]
    wanted = grid.select(*keys, F.floor(F.col("row") / side).alias("_r"), F.floor(F.col("col") / side).alias("_c"), "row", "col").dropna()
    given = source.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), *bands).dropna(subset=[*keys, "sr", "sc"])
    for at, name in (("sr", "_r"), ("sc", "_c")):
        first, last = (F.floor(((F.col(at) + (sign * (reach + 1) + 0.5)) / scale - 0.5) / side) for sign in (-1, 1))
        given = given.withColumn(name, F.explode(F.sequence(first, last)))

    def weights(at: np.ndarray, low: int, size: int) -> np.ndarray:
        """Of each pixel (row or column ``at``) and each source place from ``low`` on."""
        place = (at + 0.5) * scale - 0.5
        return _kernel(method, (place[:, None] - np.arange(low, low + size)) / wide)

    def run(pixels: pa.Table, taps: pa.Table) -> pa.Table:
        row, col, sr, sc = pixels["row"].to_numpy(), pixels["col"].to_numpy(), taps["sr"].to_numpy(), taps["sc"].to_numpy()
        if not len(row) or not len(sr):
            return schema.empty_table()
        rows, y = np.unique(row, return_inverse=True)
        cols, x = np.unique(col, return_inverse=True)
        single = np.unique(y * len(cols) + x, return_index=True)[1]  # a pixel that is asked for twice is one
        y, x = y[single], x[single]
        (r0, h), (c0, w) = ((int(v.min()), int(v.max() - v.min()) + 1) for v in (sr, sc))
        wy, wx = weights(rows, r0, h), weights(cols, c0, w)
        cell = (sr - r0) * w + (sc - c0)
        spread = lambda v, cells=cell: np.bincount(cells, weights=v, minlength=h * w).reshape(h, w)
        met = lambda there: (((wy != 0).astype(float) @ there @ (wx != 0).astype(float).T)[y, x]) > 0.5
        there = spread(np.ones(len(cell)))
        some, total = met(there), (wy @ there @ wx.T)[y, x]
        out = []
        for b in bands:
            value = pc.cast(taps[b], pa.float64())
            known = ~value.is_null().to_numpy()
            sums = (wy @ spread(value.to_numpy()[known], cell[known]) @ wx.T)[y, x]
            ok = some & (total != 0) & (met(spread(np.ones(int(known.sum())), cell[known])) if not known.all() else True)
            out.append(pa.array(sums / np.where(ok, total, 1.0), mask=~ok))
        seen = pa.array(single[some])
        found = [pixels[k].take(seen) for k in (*keys, "row", "col")]
        return pa.Table.from_arrays([*found, *[v.filter(pa.array(some)) for v in out]], [*keys, "row", "col", *bands]).cast(schema)

    kinds = wanted.select(*keys, "row", "col").schema
    for b in bands:
        kinds = kinds.add(b, "double")
    schema = to_arrow_schema(kinds)
    return wanted.groupBy(*keys, *square).cogroup(given.groupBy(*keys, *square)).applyInArrow(run, kinds)
