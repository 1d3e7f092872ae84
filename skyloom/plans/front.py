"""The front door: from a request and a scene table to tiles, an array or a GeoTIFF.

Scenes and tiles are joined on tile keys; every task reads the windows of its
(scene, tile) pairs straight from the assets, on the output grid, and hands on packed
blocks, so no pixel is a row and the driver sees none.  A scene that cannot be read
after all attempts is left out and reported; the mosaic is made of the others.
"""

from __future__ import annotations

import json
import logging
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import arrays, blocks, tiles
from ..operators.coverage import polygons
from ..sources import assets, catalog, geotiff
from ..sources.retry import PROGRAMMING, SceneFetchError, report_dropped
from . import engine
from .request import MosaicRequest

log = logging.getLogger("skyloom")

#: Side of an output tile, and of a block in files, in pixels; a task holds one tile of all scenes.
TILE, FILE_TILE = 512, 256
#: Metres of a full tile's side; pixels of context that a classifier gets at least.
FULL_SIDE, CONTEXT = 109_800, 100
#: Bands that a cloud classifier sees.
CLASSIFIER_BANDS = ("B04", "B03", "B8A")
#: Scenes that the gate of sparse reads looks at.
GATE_SCENES = 5

READ_SCHEMA = blocks.BLOCK_SCHEMA + ", failed string"
Classifier = Callable[[np.ndarray], np.ndarray]


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` (where that is unset, as in tests, a temporary folder) and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/skyloom-shared"
    path = f"{base.rstrip('/')}/skyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Mosaic:
    """A finished mosaic: packed tiles (r, c, h, w, bands, n) on a grid."""

    tiles: DataFrame
    grid: geotiff.Grid
    request: MosaicRequest
    dropped: list[dict[str, str]]

    @property
    def bands(self) -> list[str]:
        return names.band_labels(list(self.request.bands))

    @property
    def band_names(self) -> list[str]:
        """Names of the output's bands, the count among them if the request asks for it."""
        return names.band_labels(list(self.request.bands), self.request.include_observation_count)

    @property
    def dtype(self) -> str:
        """Colours are 8 bits, unless a count of 16 bits is with them; all else is 16 bits."""
        return "uint8" if "visual" in self.request.bands and not self.request.include_observation_count else "uint16"

    def pixels(self) -> DataFrame:
        """row, col, bands, n of the observed pixels."""
        return blocks.to_pixels(self.tiles, self.bands)

    def array(self) -> np.ndarray:
        """The whole raster on the driver (bands, height, width), tile by tile."""
        out = np.zeros((len(self.band_names), self.grid.height, self.grid.width), self.dtype)
        for t in self.tiles.toLocalIterator():
            at = np.s_[t.r : t.r + t.h, t.c : t.c + t.w]
            out[: len(self.bands), *at] = np.frombuffer(t.bands, "<u2").reshape(len(self.bands), t.h, t.w)
            if self.request.include_observation_count:
                out[-1, *at] = np.frombuffer(t.n, "<u2").reshape(t.h, t.w)
        return out

    def write(self, path: str) -> str:
        """A GeoTIFF with an internal mask, and its JSON.  Tasks encode blocks; the driver only joins their bytes."""
        k, count, dtype, grid = len(self.bands), self.request.include_observation_count, self.dtype, self.grid
        planes = len(self.band_names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r, c, h, w, data, seen in zip(*(b.column(x).to_pylist() for x in ("r", "c", "h", "w", "bands", "n")), strict=True):
                    n = np.frombuffer(seen, "<u2").reshape(1, h, w)
                    values = np.frombuffer(data, "<u2").reshape(k, h, w)
                    values = (np.concatenate((values, n)) if count else values).astype(dtype)
                    out = []
                    for y in range(0, h, FILE_TILE):
                        for x in range(0, w, FILE_TILE):
                            at, number = np.s_[y : y + FILE_TILE, x : x + FILE_TILE], geotiff.place_of(r + y, c + x, grid, FILE_TILE)
                            out += [(p, number, geotiff.encode(v[at], FILE_TILE)) for p, v in enumerate(values)]
                            out.append((planes, number, geotiff.encode(n[0][at] > 0, FILE_TILE)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["plane", "number", "data"])

        encoded = self.tiles.select("r", "c", "h", "w", "bands", "n").mapInArrow(run, "plane bigint, number bigint, data binary")
        geotiff.assemble(path, ((x.plane, x.number, x.data) for x in encoded.toLocalIterator()), grid, planes, dtype, FILE_TILE, self.band_names, mask=True)
        engine.write_sidecar(path, self.request.metadata() | {"dropped_scenes": self.dropped})
        return path


# -- where the output lies


def search_area(request: MosaicRequest) -> MosaicRequest:
    """The request with its area in degrees; a box becomes the envelope of the box on the output's system."""
    if request.aoi is not None:
        return replace(request, aoi=tuple(geo.project_ring(list(request.aoi), request.input_crs, 4326)), input_crs=4326) if request.input_crs != 4326 else request
    if request.bounds is None:
        return request
    epsg = output_epsg(request)
    return replace(request, bounds=geo.project_box(geo.project_box(request.bounds, epsg, request.input_crs), 4326, epsg), input_crs=4326)


def output_epsg(request: MosaicRequest) -> int:
    """The system asked for, that of the area, or the UTM zone of its middle."""
    if request.output_crs is not None:
        return request.output_crs
    if request.input_crs != 4326:
        return request.input_crs
    x0, y0, x1, y1 = request.area_box()
    return geo.pick_utm_epsg((x0 + x1) / 2, (y0 + y1) / 2)


def output_grid(request: MosaicRequest, found: DataFrame) -> geotiff.Grid:
    """A tile's own grid, or the area's envelope (moved outward to multiples of the resolution if asked to)."""
    res = float(request.resolution)
    if request.grid_id is not None:
        at = found.where("origin_x is not null and origin_y is not null and epsg is not null").orderBy("rank").select("origin_x", "origin_y", "epsg").first()
        if at is None:
            raise ValueError("no scene tells where its grid lies (proj:transform and proj:epsg)")
        side = round(FULL_SIDE / res)
        return geotiff.Grid(res, at.origin_x, at.origin_y, side, side, at.epsg)
    epsg = output_epsg(request)
    x0, y0, x1, y1 = geo.project_box(request.area_box(), epsg, request.input_crs)
    if request.snap_to_source_grid:
        x0, y0, x1, y1 = math.floor(x0 / res) * res, math.floor(y0 / res) * res, math.ceil(x1 / res) * res, math.ceil(y1 / res) * res
    return geotiff.Grid(res, x0, y1, max(1, round((x1 - x0) / res)), max(1, round((y1 - y0) / res)), epsg)


def to_pixels(ring: list[tuple[float, float]], grid: geotiff.Grid, epsg: int) -> list[tuple[float, float]]:
    return [((x - grid.minx) / grid.res, (grid.maxy - y) / grid.res) for x, y in geo.project_ring(ring, epsg, grid.epsg)]


def footprints(found: DataFrame, grid: geotiff.Grid) -> DataFrame:
    """scene_id, shape (polygons of rings in pixels, JSON) and its window r0, c0, r1, c1 (empty windows left out)."""
    known = "geometry" in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, row in enumerate(b.to_pylist()):
                shape = polygons(row["type"], row["coordinates"]) if known else []
                if not shape and None not in (box := [row[c] for c in ("x0", "y0", "x1", "y1")]):
                    shape = [[[(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]]]
                placed = [[to_pixels([tuple(p) for p in ring], grid, 4326) for ring in rings] for rings in shape]
                at = [p for rings in placed for ring in rings for p in ring]
                if not at:
                    continue
                xs, ys = zip(*at, strict=True)
                window = [max(0, math.floor(min(ys))), max(0, math.floor(min(xs))), min(grid.height, math.ceil(max(ys))), min(grid.width, math.ceil(max(xs)))]
                if window[0] < window[2] and window[1] < window[3]:
                    rows.append((i, json.dumps(placed), *window))
            ids = b.column("scene_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(2, 6)]], ["scene_id", "shape", "r0", "c0", "r1", "c1"])

    kind = found.schema["scene_id"].dataType.simpleString()
    columns = ["scene_id", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], *(["geometry.type", "geometry.coordinates"] if known else [])]
    return found.select(*columns).mapInArrow(run, f"scene_id {kind}, shape string, r0 bigint, c0 bigint, r1 bigint, c1 bigint")


# -- what a task reads


class BlockReader:
    """The valid pixels of one scene in one tile, on the output grid."""

    def __init__(self, request: MosaicRequest, grid: geotiff.Grid, source: catalog.Source, ring: list | None, sign: assets.Sign, classify: Classifier | None, open_with: Callable | None):
        self.request, self.grid, self.source, self.ring, self.classify = request, grid, source, ring, classify
        self.handles = assets.Handles(sign, open_with=open_with or assets.open_address)
        self.template = names.asset_template(list(request.bands))
        most = 50 if request.cloud_mask == "OCM" else math.inf
        self.mask_grid = assets.coarser(grid, min(max(request.resolution, 20), most))

    def band(self, hrefs: dict[str, str], name: str, grid: geotiff.Grid, row: int, col: int, height: int, width: int, method: str) -> np.ndarray:
        href = hrefs.get(self.source.asset(name)) or hrefs.get(name)
        if href is None:
            raise SceneFetchError("", f"no asset for {name}")
        return self.handles.read(href, lambda reader: assets.window_on(reader, grid, row, col, height, width, method))

    def mask(self, hrefs: dict[str, str], row: int, col: int, height: int, width: int) -> np.ndarray:
        """Valid pixels by the scene's classes or by a classifier, made on the mask's grid with the context that growing needs."""
        g, m = self.grid, self.mask_grid
        rows, cols = (row + np.arange(height)) * m.height // g.height, (col + np.arange(width)) * m.width // g.width
        pad = arrays.GROWTH
        y0, x0 = max(0, int(rows[0]) - pad), max(0, int(cols[0]) - pad)
        y1, x1 = min(m.height, int(rows[-1]) + pad + 1), min(m.width, int(cols[-1]) + pad + 1)
        if self.classify is None:
            valid = arrays.scl_valid(self.band(hrefs, "SCL", m, y0, x0, y1 - y0, x1 - x0, "nearest")[0])
        else:
            (y, h, top), (x, w, left) = arrays.context(y0, y1 - y0, CONTEXT), arrays.context(x0, x1 - x0, CONTEXT)
            bands = np.concatenate([self.band(hrefs, b, m, y, x, h, w, "nearest")[:1] for b in CLASSIFIER_BANDS])
            crop = np.s_[top : top + y1 - y0, left : left + x1 - x0]
            valid = arrays.class_clear(np.asarray(self.classify(bands)))[crop] & arrays.band_valid(bands[:, *crop])
        return valid[np.ix_(rows - y0, cols - x0)]

    def __call__(self, hrefs: dict[str, str], row: int, col: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Bands and valid pixels, or none if no pixel is valid (then no band is read)."""
        valid = np.ones((height, width), bool) if self.ring is None else arrays.touched(self.ring, row, col, height, width)
        if valid.any():
            valid &= self.mask(hrefs, row, col, height, width)
        if not valid.any():
            return None
        read = {a: self.band(hrefs, a, self.grid, row, col, height, width, self.request.resampling_method) for a in dict.fromkeys(a for a, _ in self.template)}
        return np.stack([read[a][i - 1] for a, i in self.template]).astype(np.uint16), valid


def read_blocks(pairs: DataFrame, make: Callable[[], BlockReader]) -> DataFrame:
    """Packed blocks of (scene, tile) pairs, or a row with the reason why a scene failed.

    ``pairs``: rank, hrefs, r, c, h, w.  The scene of a block is its rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with assets.network_defaults():
            yield from rows(make(), batches)

    def rows(reader: BlockReader, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [*[pa.int64()] * 6, pa.binary(), pa.binary(), pa.string()]
        try:
            for b in batches:
                for rank, hrefs, r, c, h, w in zip(*(b.column(x).to_pylist() for x in ("rank", "hrefs", "r", "c", "h", "w")), strict=True):
                    try:
                        found = reader(dict(hrefs or {}), r, c, h, w)
                        row = None if found is None else (rank, rank, r, c, h, w, *blocks.pack(*found), None)
                    except PROGRAMMING:
                        raise
                    except Exception as e:
                        row = (rank, rank, r, c, h, w, None, None, e.reason if isinstance(e, SceneFetchError) else f"{type(e).__name__}: {e}")
                    if row is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], columns)
        finally:
            reader.handles.close()

    return pairs.select("rank", "hrefs", "r", "c", "h", "w").mapInArrow(run, READ_SCHEMA)


# -- coverage of an area by enough scenes


def frequent_cover(specs: DataFrame, shapes: list, fraction: float, ring: list | None) -> DataFrame:
    """r, c, cover (bits): pixels that at least ``fraction`` of the largest count of footprints hold, and none near that fewer do.

    ``shapes``: the footprints in pixels, a few numbers for each scene found.
    """
    pad = arrays.GROWTH

    def counts(r: int, c: int, h: int, w: int, margin: int) -> np.ndarray:
        return arrays.counted(shapes, r - margin, c - margin, h + 2 * margin, w + 2 * margin)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(counts(*at, 0).max()) for at in zip(*(b.column(x).to_pylist() for x in "rchw"), strict=True)], pa.int64())], ["top"])

    top = specs.select("r", "c", "h", "w").mapInArrow(tops, "top bigint").agg(F.max("top")).first()[0] or 0
    height, width = (specs.agg(F.max(F.col("r") + F.col("h")), F.max(F.col("c") + F.col("w"))).first() or (0, 0))

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for r, c, h, w in zip(*(b.column(x).to_pylist() for x in "rchw"), strict=True):
                n = counts(r, c, h, w, pad)
                ok = (n >= top * fraction) & (top > 0)
                # pixels outside the raster are no evidence
                y, x = np.arange(r - pad, r + h + pad)[:, None], np.arange(c - pad, c + w + pad)[None]
                few = ~ok & (y >= 0) & (y < height) & (x >= 0) & (x < width)
                ok = (ok & ~arrays.dilate(few))[pad : pad + h, pad : pad + w]
                if ring is not None:
                    ok &= arrays.touched(ring, r, c, h, w)
                bits.append(np.packbits(ok).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), pa.array(bits, pa.binary())], ["r", "c", "cover"])

    return specs.select("r", "c", "h", "w").mapInArrow(covers, "r bigint, c bigint, cover binary")


def touched_tiles(specs: DataFrame, ring: list) -> DataFrame:
    """The tiles with a pixel that a ring touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = zip(*(b.column(x).to_pylist() for x in "rchw"), strict=True)
            yield b.filter(pa.array([bool(arrays.touched(ring, *x).any()) for x in at], pa.bool_()))

    return specs.select("r", "c", "h", "w").mapInArrow(run, "r bigint, c bigint, h bigint, w bigint")


def ring_cover(specs: DataFrame, ring: list) -> DataFrame:
    """r, c, cover (bits) of the pixels that a ring touches."""

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(arrays.touched(ring, r, c, h, w)).tobytes() for r, c, h, w in zip(*(b.column(x).to_pylist() for x in "rchw"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("c"), pa.array(bits, pa.binary())], ["r", "c", "cover"])

    return specs.select("r", "c", "h", "w").mapInArrow(covers, "r bigint, c bigint, cover binary")


# -- all of it


def mosaic(scenes: DataFrame, *, tile: int = TILE, sign: assets.Sign = assets.unsigned, classify: Classifier | None = None, open_with: Callable | None = None, **fields) -> Mosaic | str:
    """The mosaic that the fields of a ``MosaicRequest`` ask for; its path, if it is to be written.

    ``scenes``: as ``stac.scenes`` gives them, with ``hrefs`` (asset name to address).
    ``classify`` turns the three bands of ``CLASSIFIER_BANDS`` into classes, 0 being clear; the
    OCM mask, a neural network that is not part of this package, must be given so.
    ``sign`` makes addresses readable; ``open_with`` opens one (default: local files and Arrow's file systems).
    """
    spark = scenes.sparkSession
    request = MosaicRequest(**fields).normalized()
    request.validate()
    path = engine.export_path(request)
    if path is not None and os.path.exists(path) and not request.overwrite:
        return path
    if request.cloud_mask == "OCM" and classify is None:
        raise ValueError("cloud_mask='OCM' needs a neural network that is not part of this package; use 'SCL' or give classify")
    if tile % FILE_TILE and path is not None:
        raise ValueError(f"tile must be a multiple of {FILE_TILE}")
    found = materialised(engine.search(scenes, search_area(request)), "scenes")
    total = found.count()
    if not total:
        raise ValueError("No scenes found for the specified area and dates")
    grid = output_grid(request, found)
    ring = None if request.aoi is None else to_pixels(list(request.aoi), grid, request.input_crs)
    specs = tiles.tile_specs(spark, grid.height, grid.width, tile)
    prints = materialised(footprints(found, grid), "footprints")
    if ring is not None and request.adaptive_tiling:
        # tiles that the area does not touch are not read, where that spares enough of the source's blocks
        near = touched_tiles(specs, ring)
        if tiles.sparse_reads_pay(near, tiles.sampled(prints, GATE_SCENES, ["scene_id"]), catalog.get_source(request.source).largest_block(["SCL"])):
            specs = near
    specs = materialised(specs, "tiles")
    pairs = tiles.meeting_windows(specs, prints.select("scene_id", "r0", "c0", "r1", "c1"), tile).join(found.select("scene_id", "rank", "hrefs"), "scene_id")
    log.info("mosaic of %d scenes on %d x %d pixels", total, grid.width, grid.height)
    source, width = catalog.get_source(request.source), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(max(width, -(-pairs.count() // 16)), "rank", "r", "c")
    read = materialised(read_blocks(dealt, lambda: BlockReader(request, grid, source, ring, sign, classify, open_with)), "blocks")
    failed = read.where("failed is not null").groupBy("rank").agg(F.min("failed").alias("reason")).join(found.select("rank", "scene_id"), "rank").orderBy("rank").collect()  # at most one row a scene
    dropped = report_dropped([SceneFetchError(str(x.scene_id), x.reason) for x in failed])
    if len(failed) == total:
        raise RuntimeError(f"all {total} scenes failed: {dropped[0]['reason']}")
    good = read.where("failed is null").drop("failed")
    if failed:
        good = good.where(~F.col("rank").isin([x.rank for x in failed]))
    if good.isEmpty():
        raise RuntimeError("no scene has a valid pixel in the area and dates")
    cover = None
    if request.min_coverage_fraction is not None:
        shapes = [[[[tuple(p) for p in r] for r in rings] for rings in json.loads(x.shape)] for x in prints.select("shape").toLocalIterator()]
        cover = frequent_cover(specs, shapes, request.min_coverage_fraction, ring)
    elif ring is not None:
        cover = ring_cover(specs, ring)
    bands = names.band_labels(list(request.bands))
    done = blocks.mosaic(good, len(bands), request.mosaic_method, percentile=request.percentile, max_observations=request.max_observations, min_observations=request.min_observations, cover=cover)
    result = Mosaic(materialised(done, "mosaic"), grid, request, dropped)
    log.info("mosaic done, %d scenes dropped", len(dropped))
    return result if path is None else result.write(path)
