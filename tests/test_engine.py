"""Requests, names, geometry, files and the whole mosaic."""

from __future__ import annotations

import datetime as dt
import functools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo, names
from skyloom.operators import coverage, masks, resample
from skyloom.plans import engine
from skyloom.plans.request import MosaicRequest
from skyloom.sources import catalog, geotiff, stac
from skyloom.sources.tiles import TileSource
from skyloom.streaming import incremental

BOX = (115.83, -31.97, 115.91, -31.94)


def ok(**more):
    return MosaicRequest(**({"bounds": BOX, "start_year": 2023, "start_month": 6, "duration_days": 14, "cloud_mask": "SCL"} | more)).normalized()


@pytest.mark.parametrize(
    ("change", "words"),
    [
        ({"grid_id": "50HMH"}, "Exactly one of"),
        ({"start_year": None}, "start_year must be provided"),
        ({"start_year": -1}, "must be positive"),
        ({"source": "X"}, "Invalid source"),
        ({"cloud_mask": "no"}, "Invalid cloud_mask"),
        ({"scene_order": "no"}, "Invalid scene_order"),
        ({"mosaic_method": "no"}, "Invalid mosaic method"),
        ({"resampling_method": "no"}, "Invalid resampling method"),
        ({"output_crs": 4326}, "geographic CRS"),
        ({"resolution": 0}, "resolution must be positive"),
        ({"min_observations": 0}, "min_observations must be a positive integer"),
        ({"max_observations": True}, "max_observations must be a positive integer"),
        ({"min_observations": 3, "max_observations": 2}, "must be >= "),
        ({"tile_workers": 0}, "tile_workers must be a positive integer"),
        ({"adaptive_tiling": 1}, "adaptive_tiling must be a bool"),
        ({"min_coverage_fraction": 1.5}, "min_coverage_fraction must be between"),
        ({"bands": ["B99"]}, "Invalid band"),
        ({"bands": ["visual", "B02"]}, "visual"),
        ({"percentile": 5.0}, "only valid for percentile"),
        ({"mosaic_method": "percentile"}, "percentile must be provided"),
        ({"mosaic_method": "percentile", "percentile": 101.0}, "between 0 and 100"),
        ({"bounds": (1, 2, 3)}, "minx, miny"),
        ({"bounds": (2, 2, 1, 3)}, "Invalid bounds"),
        ({"bounds": (10, -95, 11, -94)}, "latitude"),
        ({"bounds": (190, 0, 191, 1)}, "longitude"),
        ({"bounds": (10, 0, 10.00001, 1)}, "at least"),
        ({"output_crs": 4283}, "geographic CRS"),
        ({"output_crs": 2154}, "not supported"),
        ({"input_crs": 27700}, "not supported"),
        ({"bounds": None, "aoi": ((0, 0), (1, 1), (1, 0), (0, 1))}, "positive area|crosses itself"),
        ({"bounds": None, "aoi": ((0, 0), (3, 3), (3, 0), (0, 2))}, "crosses itself"),
        ({"bounds": None, "aoi": ((0, 0), (1, 1))}, "must not be empty"),
        ({"show_progress": 1}, "show_progress must be a bool"),
        ({"ocm_batch_size": 0}, "ocm_batch_size must be a positive integer"),
        ({"ocm_inference_dtype": "int8"}, "Invalid ocm_inference_dtype"),
    ],
)
def test_refused(change, words):
    with pytest.raises(ValueError, match=words):
        ok(**change).validate()


def test_median_is_percentile_50():
    r = ok(mosaic_method="median")
    r.validate()
    assert (r.mosaic_method, r.percentile) == ("percentile", 50.0)
    with pytest.raises(ValueError, match="should not be set"):
        ok(mosaic_method="median", percentile=10.0)


def test_code_ignores_where_it_is_written():
    assert ok().code() == ok(output_dir="/x", overwrite=False, tile_workers=3).code() != ok(resolution=20).code()
    assert ok(scene_sort_fn=lambda items: items).code() != ok(scene_sort_fn=lambda items: items.limit(1)).code()


class Sorter:
    def __init__(self, limit):
        self.limit = limit

    def sort(self, items):
        return items.limit(self.limit)

    def __call__(self, items):
        return items.limit(self.limit)


def test_code_of_callables():
    def sort(items, *, n=1):
        return items.limit(n)

    def other(items, *, n=2):
        return items.limit(n)

    other.__qualname__ = sort.__qualname__
    code = lambda f: ok(scene_sort_fn=f).code()
    assert code(Sorter(1).sort) == code(Sorter(1).sort) != code(Sorter(2).sort)
    assert code(Sorter(1)) == code(Sorter(1)) != code(Sorter(2))
    assert code(functools.partial(sort, n=3)) == code(functools.partial(sort, n=3)) != code(functools.partial(sort, n=4))
    assert code(sort) != code(other)
    nested = [eval(f"lambda items: (lambda x: x.limit({n}))(items)") for n in (1, 1, 2)]
    assert code(nested[0]) == code(nested[1]) != code(nested[2])
    with pytest.raises(ValueError, match="cannot be hashed"):
        code(Sorter(iter([])))
    loop = Sorter(1)
    loop.limit = loop
    with pytest.raises(ValueError, match="contains itself"):
        code(loop)


def test_projections_there_and_back():
    for epsg, lon, lat, x, y in ((3577, 132.0, 0.0, 0.0, 0.0), (5070, -96.0, 23.0, 0.0, 0.0), (3857, 180.0, 0.0, 20037508.342789244, 0.0), (32631, 3.0, 0.0, 500000.0, 0.0), (3577, 149.1, -35.3, None, None), (5070, -80.2, 35.1, None, None), (32750, 115.9, -31.9, None, None)):
        at = geo.project(lon, lat, epsg)
        assert x is None or at == pytest.approx((x, y), abs=1e-3)
        back = geo.transform(*np.array([at]).T, epsg, 4326)
        assert (back[0][0], back[1][0]) == pytest.approx((lon, lat), abs=1e-8)
    # equal areas: a small square keeps its size in the Albers systems
    for epsg, lon, lat in ((3577, 120.0, -20.0), (5070, -110.0, 45.0)):
        ring = geo.project_ring([(lon, lat), (lon + 0.01, lat), (lon + 0.01, lat + 0.01), (lon, lat + 0.01)], 4326, epsg)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2
        e2, s = geo.E1**2, [np.sin(np.radians(v)) for v in (lat, lat + 0.01)]
        q = [v / (2 * (1 - e2 * v * v)) + np.log((1 + geo.E1 * v) / (1 - geo.E1 * v)) / (4 * geo.E1) for v in s]
        assert area == pytest.approx(geo.A**2 * (1 - e2) * np.radians(0.01) * (q[1] - q[0]), rel=1e-6)


def test_dates_and_names(tmp_path):
    assert names.end_date(dt.date(2024, 1, 31), months=1) == dt.date(2024, 2, 29)
    assert [names.safe_token(x) for x in (-1.5, 2.25, "a b")] == ["neg1p5000", "2p2500", "a_b"]
    assert names.method_token("percentile", 25.0) == "percentile-p25"
    r = MosaicRequest(grid_id="50hmh ", start_year=2023, start_month=6, duration_days=7, bands=("B04", "B03"), scene_order="oldest", output_dir=str(tmp_path)).normalized()
    assert engine.export_path(r).endswith(f"grid-50HMH_2023-06-01_to_2023-06-08_B04-B03_mean_scene-oldest_10m_OCM_MPC_{r.code()}.tif")


@pytest.mark.parametrize(("value", "valid"), [("50HMK", True), ("1FBE", True), ("60XVQ", True), (" 50hmk ", True), ("01CAA", False), ("50AMK", False), ("50IMK", False), ("61HMK", False), ("50HM", False)])
def test_grid_ids(spark, value, valid):
    got = spark.createDataFrame([(value,)], "g string").select(names.grid_id(F.col("g")).alias("g")).first().g
    assert (got is not None) == valid
    if not valid:
        with pytest.raises(ValueError, match="grid_id"):
            names.normalize_grid_id(value)


def test_utm():
    assert geo.pick_utm_epsg(115.9, -31.9) == 32750 and geo.pick_utm_epsg(180, 10) == 32660
    with pytest.raises(ValueError, match="UTM range"):
        geo.pick_utm_epsg(0, 85)
    assert geo.forward(3.0, 0.0, 31) == pytest.approx((500000.0, 0.0), abs=1e-3)
    assert geo.forward(3.0, 45.0, 31) == pytest.approx((500000.0, 4982950.400), abs=2e-3)
    x0, y0, x1, y1 = geo.project_box(BOX, 32750)
    assert 7000 < x1 - x0 < 8000 and 3000 < y1 - y0 < 4000
    assert geo.clip_ring([(0, 0), (10, 0), (10, 10), (0, 10)], (5, 5, 20, 20))


def test_dilation_is_a_diamond(spark):
    pixels = spark.range(2500).selectExpr("id div 50 as row", "id % 50 as col")
    hole = pixels.where("row = 25 and col = 25")
    left = masks.away_from(pixels, hole, [], "row", "col", 4)
    gone = {(r.row, r.col) for r in pixels.exceptAll(left).collect()}
    assert gone == {(25 + a, 25 + b) for a, b in masks.diamond(4)}


def test_classes(spark):
    got = spark.range(12).select("id", masks.clear(F.col("id")).alias("c")).collect()
    assert {r.id for r in got if r.c} == {0, 4, 5, 6, 11}


def test_latest_baseline_and_properties(spark):
    rows = spark.createDataFrame([("a", "2023-06-01 00:00:00.1", "50HMH", "not-a-number"), ("b", "2023-06-01 00:00:00.9", "50HMH", "05.11"), ("c", "2023-06-01 00:00:00", None, "01.00")], "id string, t string, tile string, base string").withColumn("t", F.col("t").cast("timestamp"))
    assert {r.id for r in catalog.latest_baseline(rows, "t", "tile", "base", ["id"]).collect()} == {"b", "c"}
    where = catalog.property_filter({"tile": {"startsWith": "50"}, "base": {"gt": 1}}, F.col)
    assert [r.id for r in rows.where(where).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown query operator"):
        catalog.property_filter({"tile": {"like": "x"}}, F.col)


def test_frequent_coverage_empty_and_full(spark):
    grid = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col")
    none = spark.createDataFrame([], "x0 double, y0 double, x1 double, y1 double")
    assert coverage.frequent(coverage.overlap_count(grid, none), 0.5).count() == 0
    one = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], none.schema)
    assert coverage.frequent(coverage.overlap_count(grid, one), 0.5).count() == 100


def test_constant_images_resample_to_themselves(spark):
    source = spark.range(64).selectExpr("id div 8 as row", "id % 8 as col", "7 as b")
    grid = spark.range(256).selectExpr("id div 16 as row", "id % 16 as col")
    for method in ("bilinear", "cubic", "lanczos"):
        got = resample.convolve(grid, source, [], 0.5, method, ["b"]).collect()
        assert len(got) == 256 and all(abs(r.b - 7) < 1e-9 for r in got)
    near = resample.nearest(grid, source, [], 8, 8, 16, 16, ["b"])
    assert near.count() == 256


@pytest.mark.parametrize("method", ["bilinear", "cubic", "lanczos"])
@pytest.mark.parametrize("scale", [0.5, 2, 2.7, 0.3])
def test_convolution_by_brute_force(spark, monkeypatch, method, scale):
    """Two scenes with holes, a tap that is there twice and one without a value, over many squares; no table of taps is joined."""
    monkeypatch.setattr(resample, "SIDE", 8)
    rng = random.Random(6)
    source = [(s, y, x, rng.randrange(10_000)) for s in "ab" for y in range(12) for x in range(17) if rng.random() < 0.6]
    source += [(*source[5][:3], 17), (*source[9][:3], None), ("c", 0, 0, 1), (None, 3, 3, 5)]
    size = int(12 / scale), int(17 / scale)
    grid = [(s, y, x) for s in "abd" for y in range(size[0]) for x in range(size[1])]
    grid += [grid[4], (None, 1, 1)]
    wide, reach = max(1, scale), {"bilinear": 1, "cubic": 2, "lanczos": 3}[method]

    def kernel(t):
        a = abs(t) / wide
        if a >= reach:
            return 0.0
        if method == "bilinear":
            return 1 - a
        if method == "cubic":
            return 1.5 * a**3 - 2.5 * a * a + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2
        return 1.0 if a < 1e-12 else 3 * math.sin(math.pi * a) * math.sin(math.pi * a / 3) / (math.pi * a) ** 2

    want = {}
    for s, y, x in {g for g in grid if g[0]}:
        w = [(kernel((y + 0.5) * scale - 0.5 - b) * kernel((x + 0.5) * scale - 0.5 - c), v) for k, b, c, v in source if k == s]
        w = [(i, v) for i, v in w if i != 0]
        if w:
            want[s, y, x] = sum(i * v for i, v in w if v is not None) / sum(i for i, _ in w) if any(v is not None for _, v in w) else None
    done = resample.convolve(spark.createDataFrame(grid, "s string, row int, col long"), spark.createDataFrame(source, "s string, row long, col long, b long"), ["s"], scale, method, ["b"])
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.dtypes == [("s", "string"), ("row", "int"), ("col", "bigint"), ("b", "double")]
    rows = done.collect()
    got = {(r.s, r.row, r.col): r.b for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-5 * max(1, abs(want[k]))) for k in want)


def test_geotiff_round_trip_and_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 65536, (3, 70, 50)).astype(np.uint16)
    path, grid = str(tmp_path / "a.tif"), geotiff.Grid(10.0, 399960.0, 6500020.0, 50, 70, 32750)
    geotiff.write(path, [(r, c, image[:, r : r + 32, c : c + 32]) for r in range(0, 70, 32) for c in range(0, 50, 32)], grid, 3, names=["B04", "B03", "B02"], tile=32)
    reader = geotiff.Reader(path)
    assert reader.grid == grid and reader.names == ["B04", "B03", "B02"]
    assert (reader.window(0, 0, 70, 50) == image).all()
    edge = reader.window(60, 40, 20, 20)
    assert (edge[:, :10, :10] == image[:, 60:, 40:]).all() and not edge[:, 10:].any()
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"]
    spark.dataSource.register(TileSource)
    rows = spark.read.format("skyloom_tiles").option("tile", 32).load(str(tmp_path)).collect()
    for r in rows:
        assert (np.frombuffer(r.bands, "<u2").reshape(3, r.h, r.w) == image[:, r.r : r.r + r.h, r.c : r.c + r.w]).all()
    assert len(rows) == 6


def test_whole_mosaic(spark, tmp_path):
    scenes = spark.createDataFrame([(i, "50HMH", dt.datetime(2023, 6, 1 + i), 0.0, 0.0, 20.0, 20.0, i % 2, 0, i, 0, "05.09") for i in range(3)], "scene_id long, tile string, datetime timestamp, x0 double, y0 double, x1 double, y1 double, orbit int, nodata int, cloud int, shadow int, baseline string")
    pixels = spark.createDataFrame([(s, y, x, 4, 10 * s + 10, 20 * s + 10) for s in range(3) for y in range(20) for x in range(20)], "scene long, row long, col long, scl int, B04 long, B03 long")
    grid = pixels.select("row", "col").distinct()
    request = MosaicRequest(grid_id="50HMH", start_year=2023, start_month=6, duration_days=30, bands=("B04", "B03"), cloud_mask="SCL", additional_query={}, output_dir=str(tmp_path), include_observation_count=True)
    done = engine.mosaic(scenes, pixels, grid, request)
    assert {(r.B04, r.B03, r.n, r.valid) for r in done.collect()} == {(20, 30, 3, 255)}
    path = engine.export(done, request, geotiff.Grid(10.0, 0.0, 200.0, 20, 20, 32750), tile=16)
    reader = geotiff.Reader(path)
    assert reader.names == ["B04", "B03", "Observation count"] and {int(x) for x in np.unique(reader.window(0, 0, 20, 20)[2])} == {3}
    meta = json.loads(open(path.replace(".tif", ".json")).read())
    assert meta["filename_hash"] == request.normalized().code() and meta["dropped_scenes"] == []
    with pytest.raises(ValueError, match="No scenes found"):
        engine.mosaic(scenes, pixels, grid, MosaicRequest(grid_id="50HMK", start_year=2023, duration_days=3, bands=("B04",), cloud_mask="SCL"))
    ring = [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]
    part = engine.mosaic(scenes, pixels, grid, request, ring=ring)
    assert 36 <= part.where("n > 0").count() <= 64


def stac_scenes(spark, tmp_path, shapes):
    item = lambda k, ring, cloud: {"id": k, "bbox": [min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring)], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": "2023-06-03T02:00:00Z", "s2:mgrs_tile": "50HMH", "s2:processing_baseline": "05.09", "s2:product_uri": f"S2A_R060_T50HMH_{k}", "eo:cloud_cover": cloud}, "assets": {}}
    (tmp_path / "items.json").write_text(json.dumps({"type": "FeatureCollection", "features": [item(*x) for x in shapes]}))
    return stac.scenes(stac.read_items(spark, str(tmp_path / "items.json")))


def test_mosaic_of_stac_scenes(spark, tmp_path):
    place = geotiff.Grid(100.0, 390000.0, 6470000.0, 40, 40, 32750)
    corner = lambda c, r: list(geo_degrees(spark, place.minx + c * 100, place.maxy - r * 100))
    left = [corner(-9, -9), corner(20, -9), corner(20, 49), corner(-9, 49), corner(-9, -9)]
    steep = [corner(-9, -9), corner(49, -9), corner(-9, 49), corner(-9, -9)]
    scenes = stac_scenes(spark, tmp_path, [("a", left, 5), ("b", steep, 7.5), ("c", left, 100)])
    grid = spark.range(1600).selectExpr("id div 40 as row", "id % 40 as col")
    counts = {(r.row, r.col): r.n for r in coverage.footprint_count(grid, scenes, place).collect()}
    assert counts[5, 5] == 3 and counts[35, 5] == 2 + (35 + 5 < 39) and counts[5, 30] == 1 and counts[35, 35] == 0 and counts[0, 19] == 3 and counts[0, 20] == 1
    pixels = spark.createDataFrame([("a",), ("b",), ("c",)], "scene string").crossJoin(grid).selectExpr("*", "4 as scl", "case scene when 'a' then 10L when 'b' then 20L else 1000L end as B04")
    request = MosaicRequest(bounds=(115.0, -33.0, 116.5, -31.0), start_year=2023, start_month=6, duration_days=30, bands=("B04",), cloud_mask="SCL", min_coverage_fraction=0.9, ignore_duplicate_items=False)
    done = {(r.row, r.col): (r.B04, r.n) for r in engine.mosaic(scenes, pixels, grid, request, place=place).collect()}
    assert done[5, 5] == (15, 2) and done[5, 30] == (0, 0) and done[35, 35] == (0, 0)
    with pytest.raises(ValueError, match="needs place"):
        engine.mosaic(scenes, pixels, grid, request)


def test_area_is_searched_by_its_polygon(spark, tmp_path):
    box = lambda x, y, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
    ring = ((115.0, -32.0), (116.0, -32.0), (115.0, -31.0))
    scenes = stac_scenes(spark, tmp_path, [("far", box(115.8, -31.2, 0.1), 5), ("in", box(115.1, -31.9, 0.1), 5), ("cut", box(115.4, -31.6, 0.4), 5), ("round", box(114.0, -33.0, 4.0), 5), ("slant", [[115.9, -31.1], [116.1, -31.9], [116.1, -31.0], [115.9, -31.1]], 5)])
    request = MosaicRequest(aoi=ring, start_year=2023, start_month=6, duration_days=30, ignore_duplicate_items=False).normalized()
    assert {r.scene_id for r in engine.search(scenes, request).collect()} == {"in", "cut", "round"}
    assert {r.scene_id for r in engine.search(scenes.drop("geometry"), request).collect()} == {"in", "cut", "round"}


@pytest.mark.parametrize("change", [{"resampling_method": "cubic"}, {"input_crs": 32750, "bounds": (390000, 6460000, 400000, 6470000)}, {"output_crs": 32750}, {"snap_to_source_grid": True}, {"adaptive_tiling": False}])
def test_options_that_are_not_carried_out_are_refused(change):
    with pytest.raises(ValueError, match="not carried out"):
        engine.mosaic(None, None, None, ok(**change))


def geo_degrees(spark, x, y):
    lon, lat = geo.utm_inverse(F.lit(float(x)), F.lit(float(y) - geo.FALSE_NORTHING), F.lit(50))
    return spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()


def test_stream_of_scenes(spark, tmp_path):
    schema = "px long, rank long, b1 long, b2 long"
    spark.createDataFrame([(1, 1, 10, 4), (1, 2, 21, 6), (2, 1, 5, 5)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = incremental.running_mean(stream, ["px"], ["b1", "b2"]).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.px, r.b1, r.b2, r.n) for r in spark.table("running").collect()} == {(1, 15, 5, 2), (2, 5, 5, 1)}
