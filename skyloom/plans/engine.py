"""The whole mosaic: search, order, mask, restrict, reduce, write.

Scenes and pixels are tables.  ``scenes`` has a row for each scene (scene_id,
tile, datetime, x0, y0, x1, y1 in degrees, orbit, nodata, cloud, shadow, baseline,
any queried properties as columns with ``:`` written ``_`` or in a map ``props``,
and, if known, the footprint as ``geometry``), as ``stac.scenes`` gives it; ``pixels``
has scene, row, col, scl and a column for each band, on the output grid.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import blocks, coverage, masks, reduce
from ..sources import catalog, geotiff
from .request import MosaicRequest

TILE = 256


def search(scenes: DataFrame, request: MosaicRequest) -> DataFrame:
    """Scenes of the area, the dates and the query, one baseline each, ranked."""
    start, end = request.dates()
    found = scenes.where(catalog.in_time(F.col("datetime"), start.isoformat(), end.isoformat()))
    if request.grid_id is not None:
        found = found.where(F.col("tile") == request.grid_id)
    else:
        box = request.bounds
        if box is None:
            xs, ys = [p[0] for p in request.aoi], [p[1] for p in request.aoi]
            box = (min(xs), min(ys), max(xs), max(ys))
        found = found.where(catalog.overlaps([F.col(c) for c in ("x0", "y0", "x1", "y1")], box))
        if request.aoi is not None:
            found = meeting(found, list(request.aoi))
    known = set(scenes.columns)

    def value(name: str) -> Column:
        column = name.replace(":", "_")
        given = [F.col(column).cast("string")] if column in known else []
        given += [F.try_element_at("props", F.lit(name)).cast("string")] if "props" in known else []
        return F.coalesce(*given) if given else F.lit(None).cast("string")

    found = found.where(catalog.property_filter(request.additional_query or {}, value))
    if request.ignore_duplicate_items and "baseline" in known:
        found = catalog.latest_baseline(found, "datetime", "tile", "baseline", ["scene_id"])
    found = found.withColumn("good", catalog.good_share(F.col("nodata"), F.col("cloud"), F.col("shadow")))
    return catalog.ranked(found, request.scene_order, sort=request.scene_sort_fn)


def meeting(scenes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Scenes whose footprint (its geometry if known, else its box) meets a ring in degrees."""
    known = "geometry" in scenes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = zip(*(b.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True)
            shapes = b.column("geometry").to_pylist() if known else [None] * b.num_rows
            keep = []
            for (x0, y0, x1, y1), shape in zip(boxes, shapes, strict=True):
                parts = coverage.polygons(shape["type"], shape["coordinates"]) if shape else [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]
                keep.append(any(geo.polygons_meet(rings, [ring]) for rings in parts))
            yield b.filter(pa.array(keep, pa.bool_()))

    return scenes.mapInArrow(run, scenes.schema)


def refuse_unconnected(request: MosaicRequest, place: geotiff.Grid | None) -> None:
    """A ValueError for options that ``mosaic`` cannot carry out: pixels come on the output grid."""
    if request.output_crs is not None and (place is None or place.epsg != request.output_crs):
        raise ValueError(f"output_crs={request.output_crs} is not carried out: give place, a grid in it that the pixels lie on")
    for name, only in (("resampling_method", "nearest"), ("input_crs", 4326), ("snap_to_source_grid", False), ("adaptive_tiling", True)):
        if getattr(request, name) != only:
            raise ValueError(f"{name}={getattr(request, name)!r} is not carried out by mosaic; only {only!r} is")


def mosaic(scenes: DataFrame, pixels: DataFrame, grid: DataFrame, request: MosaicRequest, *, place: geotiff.Grid | None = None, ring: list[tuple[float, float]] | None = None, tile: int = TILE, mask_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """row, col, the bands, n and valid for every pixel of ``grid`` (row, col).

    ``place``: where ``grid`` lies, needed for ``min_coverage_fraction``, which counts
    the footprints of the scenes.  ``ring``: the area in pixel coordinates, if the request has one.  ``mask_fn``
    keeps the valid rows of the ranked pixels in place of the class mask; the OCM
    mask, a neural network that is not part of this package, must be given so.
    No scene found is a ValueError.
    """
    request = request.normalized()
    request.validate()
    if request.cloud_mask == "OCM" and mask_fn is None:
        raise ValueError("cloud_mask='OCM' needs a neural network that is not part of this package; use 'SCL' or give mask_fn")
    if request.min_coverage_fraction is not None and place is None:
        raise ValueError("min_coverage_fraction needs place, the grid that the pixels lie on")
    refuse_unconnected(request, place)
    found = search(scenes, request)
    if found.isEmpty():
        raise ValueError("No scenes found for the specified area and dates")
    bands = [n for n in names.band_labels(list(request.bands))]
    stack = pixels.join(found.select(F.col("scene_id").alias("scene"), "rank"), "scene")
    seen = mask_fn(stack) if mask_fn is not None else masks.scl_mask(stack, ["scene"], "row", "col")
    cover = grid.select("row", "col")
    if ring is not None:
        cover = coverage.burn_touched(cover, ring)
        seen = seen.join(cover, ["row", "col"], "left_semi")
    if request.min_coverage_fraction is not None:
        counts = coverage.footprint_count(grid, found, place)
        cover = cover.join(coverage.frequent(counts, request.min_coverage_fraction), ["row", "col"], "left_semi")
        seen = seen.join(cover, ["row", "col"], "left_semi")
    seen = reduce.source_valid(seen, bands)
    if request.min_observations is not None and request.mosaic_method != "first" and request.max_observations is None:
        at = [(F.col("row") - F.col("row") % tile).alias("tr"), (F.col("col") - F.col("col") % tile).alias("tc")]
        seen = reduce.stop_tiles(seen.select("*", *at), cover.select("*", *at), ["row", "col"], ["tr", "tc"], request.min_observations)
    done = reduce.mosaic(seen, ["row", "col"], bands, request.mosaic_method, percentile_q=request.percentile, max_observations=request.max_observations)
    return reduce.finish(done, grid, ["row", "col"], bands)


def export_path(request: MosaicRequest) -> str | None:
    """The explicit path, or a name from the request in its folder, or none."""
    if request.output_dir is not None and request.output_path is not None:
        raise ValueError("Only one of output_dir or output_path can be provided")
    if request.output_path is not None:
        if os.path.splitext(request.output_path)[1].lower() not in (".tif", ".tiff"):
            raise ValueError("output_path must include a .tif or .tiff filename")
        os.makedirs(os.path.dirname(request.output_path) or ".", exist_ok=True)
        return request.output_path
    if request.output_dir is None:
        return None
    os.makedirs(request.output_dir, exist_ok=True)
    if request.grid_id is not None:
        prefix = f"grid-{request.grid_id}"
    elif request.aoi is not None:
        prefix = f"aoi-{request.code()}"
    else:
        prefix = "bbox-" + "_".join(names.safe_token(float(x)) for x in request.bounds)
    start, end = request.dates()
    details = "_".join(["-".join(request.bands), names.method_token(request.mosaic_method, request.percentile), f"scene-{request.scene_order}", f"{request.resolution}m", request.cloud_mask, request.source, request.code()])
    return os.path.join(request.output_dir, f"{prefix}_{start}_to_{end}_{details}.tif")


def export(done: DataFrame, request: MosaicRequest, grid: geotiff.Grid, dropped: list[dict] | None = None, tile: int = TILE) -> str:
    """Write a finished mosaic (row, col, bands, n) as GeoTIFF with its JSON beside it.

    Tiles come to the driver one at a time.  An existing file is kept if the
    request says so.
    """
    request = request.normalized()
    path = export_path(request)
    if path is None:
        raise ValueError("output_dir or output_path must be provided")
    if os.path.exists(path) and not request.overwrite:
        return path
    bands = names.band_labels(list(request.bands))
    columns = [*bands, "n"] if request.include_observation_count else bands
    packed = blocks.from_pixels(done.withColumn("scene", F.lit(0)).withColumn("rank", F.lit(0)), columns, tile, grid.height, grid.width)

    def pieces() -> Iterator[tuple[int, int, np.ndarray]]:
        for t in packed.toLocalIterator():
            yield t.r, t.c, blocks.unpack(t.bands, t.mask, len(columns), t.h, t.w)[0]

    geotiff.write(path, pieces(), grid, len(columns), names=names.band_labels(list(request.bands), request.include_observation_count), tile=tile)
    write_sidecar(path, request.metadata() | {"dropped_scenes": dropped or []})
    return path


def write_sidecar(path: str, metadata: dict) -> str:
    target = os.path.splitext(path)[0] + ".json"
    part = f"{target}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as out:
        out.write(json.dumps(metadata, indent=2, sort_keys=True) + "\n")
    os.replace(part, target)
    return target
