"""The whole way from a request to pixels, files of several layouts, and the arrays behind it."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import skyloom
from skyloom.functions import geo
from skyloom.operators import arrays, coverage, masks, tiles
from skyloom.plans import front
from skyloom.sources import assets, geotiff, stac

EPSG, SIDE = 32750, 120
MINX, MAXY = 399960.0, 6500020.0


def degrees(x, y):
    lon, lat = geo.transform(np.array([x]), np.array([y]), EPSG, 4326)
    return float(lon[0]), float(lat[0])


def make_scenes(spark, folder, n=3, size=SIDE, visual=False):
    """Scenes of known values: B04 is 100 * scene + row, B03 the column, classes have a cloud and a no-data corner."""
    rng, features, data = np.random.default_rng(1), [], []
    grid = geotiff.Grid(10.0, MINX, MAXY, size, size, EPSG)
    half = geotiff.Grid(20.0, MINX, MAXY, size // 2, size // 2, EPSG)
    for s in range(n):
        rows, cols = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        bands = {"B04": 100 * (s + 1) + rows, "B03": 1 + cols, "B8A": 7 + rows * 0}
        classes = np.full((size // 2, size // 2), 4)
        classes[10 * s : 10 * s + 8, 20:30] = 9
        if s == 1:
            classes[:3, :3] = 0
        href = {}
        for name, values in bands.items():
            href[name] = os.path.join(folder, f"{s}-{name}.tif")
            geotiff.write(href[name], [(0, 0, values[None].astype(np.uint16))], grid, 1, tile=64)
        href["SCL"] = os.path.join(folder, f"{s}-SCL.tif")
        geotiff.write(href["SCL"], [(0, 0, classes[None].astype(np.uint8))], half, 1, dtype="uint8", tile=32)
        if visual:
            href["visual"] = os.path.join(folder, f"{s}-visual.tif")
            geotiff.write(href["visual"], [(0, 0, rng.integers(1, 255, (3, size, size)).astype(np.uint8))], grid, 3, dtype="uint8", tile=64)
        corners = [degrees(MINX, MAXY), degrees(MINX + 10 * size, MAXY), degrees(MINX + 10 * size, MAXY - 10 * size), degrees(MINX, MAXY - 10 * size)]
        ring = [list(p) for p in [*corners, corners[0]]]
        xs, ys = zip(*ring, strict=True)
        features.append({"id": f"s{s}", "bbox": [min(xs), min(ys), max(xs), max(ys)], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": f"2023-06-0{s + 1}T02:00:00Z", "s2:mgrs_tile": "50HMH", "s2:processing_baseline": "05.09", "sat:relative_orbit": 60, "eo:cloud_cover": s, "proj:epsg": EPSG}, "assets": {k: {"href": v, "proj:transform": [10, 0, MINX, 0, -10, MAXY]} for k, v in href.items()}})
        data.append((bands, arrays.scl_valid(classes)))
    path = os.path.join(folder, "items.json")
    with open(path, "w") as out:
        json.dump({"type": "FeatureCollection", "features": features}, out)
    return stac.scenes(stac.read_items(spark, path)), data


ASK = {"start_year": 2023, "start_month": 6, "duration_days": 30, "cloud_mask": "SCL", "scene_order": "oldest", "bands": ("B04", "B03")}
BOX = (MINX + 100, MAXY - 900, MINX + 1000, MAXY - 200)


def window(data, box=BOX):
    """Stack (scene, band, h, w) and valid pixels of a box on the source's own grid, by plain indexing."""
    r0, r1, c0, c1 = int((MAXY - box[3]) / 10), int((MAXY - box[1]) / 10), int((box[0] - MINX) / 10), int((box[2] - MINX) / 10)
    stack = np.stack([np.stack([b["B04"], b["B03"]]) for b, _ in data])[:, :, r0:r1, c0:c1]
    valid = np.stack([np.kron(v, np.ones((2, 2), bool)) for _, v in data])[:, r0:r1, c0:c1]
    return stack, valid


def test_box_on_the_sources_own_grid(spark, tmp_path):
    scenes, data = make_scenes(spark, str(tmp_path))
    got = front.mosaic(scenes, bounds=BOX, input_crs=EPSG, mosaic_method="mean", include_observation_count=True, tile=32, **ASK)
    stack, valid = window(data)
    n = valid.sum(axis=0)
    want = (stack * valid[:, None]).sum(axis=0) // np.maximum(n, 1)
    image = got.array()
    assert got.grid == geotiff.Grid(10.0, BOX[0], BOX[3], 90, 70, EPSG) and got.dropped == [] and got.band_names == ["B04", "B03", "Observation count"]
    assert (image[:2] == want).all() and (image[2] == n).all() and {1, 2, 3} >= set(np.unique(n).tolist()) - {0}
    first = front.mosaic(scenes, bounds=BOX, input_crs=EPSG, mosaic_method="first", tile=64, **ASK).array()
    at = valid.argmax(axis=0)
    assert (first == np.where(valid.any(axis=0), np.take_along_axis(stack, at[None, None], axis=0)[0], 0)).all()
    some = front.mosaic(scenes, bounds=BOX, input_crs=EPSG, mosaic_method="median", min_observations=1, max_observations=2, tile=64, **ASK).pixels()
    assert some.agg(F.max("n")).first()[0] == 2


def test_box_in_degrees_and_another_system(spark, tmp_path):
    scenes, data = make_scenes(spark, str(tmp_path))
    corner, other = degrees(MINX + 200, MAXY - 700), degrees(MINX + 700, MAXY - 200)
    got = front.mosaic(scenes, bounds=(*corner, *other), resolution=20, tile=32, snap_to_source_grid=True, **ASK)
    assert got.grid.epsg == EPSG and got.grid.res == 20 and got.grid.minx % 20 == 0 and got.grid.maxy % 20 == 0
    image = got.array()
    y, x = 10, 10  # the centre of a pixel of 20 m is a corner of four of 10 m: the one below and to the right of it is taken
    row, col = int((MAXY - got.grid.maxy + 20 * y + 10) // 10), int((got.grid.minx - MINX + 20 * x + 10) // 10)
    values = [100 * (s + 1) + row for s in range(3) if data[s][1][row // 2, col // 2]]
    assert image[0, y, x] == sum(values) // len(values) and image[1, y, x] == 1 + col
    web = front.mosaic(scenes, bounds=(*corner, *other), output_crs=3857, resolution=10, resampling_method="bilinear", tile=64, **ASK)
    east, north = geo.transform(np.array([web.grid.minx + 305.0]), np.array([web.grid.maxy - 305.0]), 3857, EPSG)
    assert abs(web.array()[1, 30, 30] - (1 + (east[0] - MINX) / 10 - 0.5)) <= 1.5


def test_area_and_coverage(spark, tmp_path):
    scenes, _ = make_scenes(spark, str(tmp_path))
    ring = (degrees(MINX + 200, MAXY - 200), degrees(MINX + 900, MAXY - 200), degrees(MINX + 200, MAXY - 900))
    got = front.mosaic(scenes, aoi=ring, tile=16, **ASK)
    seen = got.array()[1] > 0
    pixels = front.to_pixels(list(ring), got.grid, 4326)
    assert seen.any() and not (seen & ~arrays.touched(pixels, 0, 0, got.grid.height, got.grid.width)).any() and not seen[-3:, -3:].any()
    outside = (MINX + 800, MAXY - 1600, MINX + 1600, MAXY - 800)
    part = front.mosaic(scenes, bounds=outside, input_crs=EPSG, min_coverage_fraction=0.5, tile=32, **ASK).array()[1] > 0
    assert part[:30, :30].all() and not part[:, 36:].any() and not part[36:].any()


def test_a_tile_in_a_file(spark, tmp_path):
    scenes, _ = make_scenes(spark, str(tmp_path), visual=True)
    out = tmp_path / "out"
    ask = ASK | {"bands": ("visual",), "resolution": 60}
    path = front.mosaic(scenes, grid_id="50hmh", output_dir=str(out), tile=256, **ask)
    reader = geotiff.Reader(path)
    assert (reader.grid.width, reader.grid.minx, reader.grid.maxy) == (1830, MINX, MAXY) and reader.names == ["Red", "Green", "Blue"] and reader.dtype == np.uint8
    image, mask = reader.window(0, 0, 300, 300), reader.window(0, 0, 300, 300, reader.mask)[0]
    # the scenes end at 20 pixels, and what is outside of them grows inward by four
    assert (mask == image.any(axis=0)).all() and mask[:16, :16].sum() > 200 and not mask[16:].any() and not mask[:, 16:].any()
    meta = json.loads(open(path.replace(".tif", ".json")).read())
    assert meta["dropped_scenes"] == [] and os.path.basename(path).startswith("grid-50HMH_2023-06-01_to_2023-07-01_visual_mean_scene-oldest_60m_SCL_MPC_")
    again = front.mosaic(None or scenes.where("1 = 0"), grid_id="50hmh", output_dir=str(out), overwrite=False, tile=256, **ask)
    assert again == path
    counted = front.mosaic(scenes, grid_id="50HMH", include_observation_count=True, tile=256, **ask)
    assert counted.dtype == "uint16" and counted.array()[3].max() == 3


def test_scenes_that_cannot_be_read(spark, tmp_path, capfd):
    scenes, data = make_scenes(spark, str(tmp_path))
    os.unlink(tmp_path / "1-B03.tif")
    got = front.mosaic(scenes, bounds=BOX, input_crs=EPSG, tile=64, include_observation_count=True, **ASK)
    stack, valid = window([data[0], data[2]])
    assert [d["id"] for d in got.dropped] == ["s1"] and "FileNotFoundError" in got.dropped[0]["reason"] and (got.array()[2] == valid.sum(axis=0)).all()
    for s in (0, 2):
        os.unlink(tmp_path / f"{s}-SCL.tif")
    with pytest.raises(RuntimeError, match="all 3 scenes failed"):
        front.mosaic(scenes, bounds=BOX, input_crs=EPSG, tile=64, **ASK)
    with pytest.raises(ValueError, match="No scenes found"):
        front.mosaic(scenes, grid_id="50HMK", **ASK)


def test_a_classifier_in_place_of_the_classes(spark, tmp_path):
    scenes, _ = make_scenes(spark, str(tmp_path))
    ask = ASK | {"cloud_mask": "OCM"}
    with pytest.raises(ValueError, match="neural network"):
        front.mosaic(scenes, bounds=BOX, input_crs=EPSG, **ask)
    got = front.mosaic(scenes, bounds=BOX, input_crs=EPSG, tile=64, classify=lambda bands: (bands[0] >= 300) * 2, include_observation_count=True, **ask)
    n = got.array()[2]
    assert n.max() == 2 and n[30, 40] == 2  # the third scene's values are 300 and more


# -- arrays


def test_arrays_keep_the_rules_of_the_pixel_operators(spark):
    rng = np.random.default_rng(3)
    classes = rng.choice([0, 4, 4, 4, 4, 9, 5], size=(30, 25), p=[0.01, 0.2, 0.2, 0.2, 0.2, 0.04, 0.15])
    rows = spark.createDataFrame([(int(y), int(x), int(classes[y, x])) for y in range(30) for x in range(25)], "row int, col int, scl int")
    want = {(r.row, r.col) for r in masks.scl_mask(rows, [], "row", "col").collect()}
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(arrays.scl_valid(classes)), strict=True)} == want
    ring = [(3.2, 4.9), (20.0, 2.5), (22.7, 19.1), (9.0, 26.0)]
    grid = rows.select("row", "col")
    want = {(r.row, r.col) for r in coverage.burn_touched(grid, ring).collect()}
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(arrays.touched(ring, 0, 0, 30, 25)), strict=True)} == want
    part = arrays.touched(ring, 10, 5, 8, 9)
    assert (part == arrays.touched(ring, 0, 0, 30, 25)[10:18, 5:14]).all()


def test_islands_and_edges():
    a = np.zeros((20, 20), bool)
    a[2:8, 2:8] = True
    a[15, 15] = True
    a[4, 4] = False
    clean = arrays.without_islands(a, 8)
    assert clean[4, 4] and not clean[15, 15] and clean[2:8, 2:8].all() and clean.sum() == 36
    labels = arrays.regions(np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 1]], bool))
    assert len(set(labels[labels > 0].tolist())) == 3 and labels[0, 3] == labels[3, 2]
    assert arrays.class_clear(np.zeros((10, 10), int)).all() and arrays.context(5, 20, 100) == (-35, 100, 40)


def test_tiles_and_windows(spark):
    specs = tiles.tile_specs(spark, 100, 130, 32)
    windows = spark.createDataFrame([("a", 0, 0, 100, 130), ("b", 31, 31, 33, 33), ("c", 5, 5, 5, 9), ("d", 96, 127, 97, 130)], "s string, r0 long, c0 long, r1 long, c1 long")
    got = {(x.s, x.r, x.c) for x in tiles.meeting_windows(specs, windows, 32).collect()}
    every = [(x.r, x.c, x.h, x.w) for x in specs.collect()]
    want = {(s, r, c) for s, r0, c0, r1, c1 in windows.collect() for r, c, h, w in every if r0 < r1 and c0 < c1 and r0 < r + h and r < r1 and c0 < c + w and c < c1}
    assert got == want and len([x for x in got if x[0] == "b"]) == 4
    assert [x.id for x in tiles.sampled(spark.range(23).withColumnRenamed("id", "id"), 5, ["id"]).orderBy("id").collect()] == [0, 5, 10, 15, 20]
    assert tiles.sparse_reads_pay(specs.where("r = 0 and c = 0"), windows, 16) and not tiles.sparse_reads_pay(specs, windows, 16)


# -- files


def plain_tiff(path, image, *, order="<", big=False, chunky=False, predictor=1, strips=None, tile=16, compression=8):
    """A TIFF of another program's making: (bands, h, w) in a given layout."""
    k, h, w = image.shape
    th, tw = (strips, w) if strips else (tile, tile)
    kind = image.dtype.newbyteorder(order)
    blocks = []
    for planes in [[image]] if chunky else [[image[b : b + 1]] for b in range(k)]:
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = planes[0][:, y : y + th, x : x + tw]
                full = np.zeros((part.shape[0], part.shape[1] if strips else th, tw), image.dtype)
                full[:, : part.shape[1], : part.shape[2]] = part
                full = full.transpose(1, 2, 0)
                if predictor == 2:
                    full = np.concatenate((full[:, :1], full[:, 1:] - full[:, :-1]), axis=1)
                raw = full.astype(kind).tobytes()
                blocks.append(zlib.compress(raw) if compression == 8 else raw)
    head = 16 if big else 8
    offsets = np.cumsum([head] + [len(b) for b in blocks])
    wide = "Q" if big else "I"
    code = 16 if big else 4
    tags = {256: (3, [w]), 257: (3, [h]), 258: (3, [image.dtype.itemsize * 8] * k), 259: (3, [compression]), 262: (3, [1]), 277: (3, [k]), 284: (3, [1 if chunky else 2]), 317: (3, [predictor]), 33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32631])}
    tags |= {273: (code, offsets[:-1].tolist()), 278: (3, [th]), 279: (code, [len(b) for b in blocks])} if strips else {322: (3, [tw]), 323: (3, [th]), 324: (code, offsets[:-1].tolist()), 325: (code, [len(b) for b in blocks])}
    body, at, entries = b"".join(blocks), int(offsets[-1]), []
    for tag, (c, values) in sorted(tags.items()):
        data = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd', 16: 'Q'}[c] }", *values)
        room = 8 if big else 4
        if len(data) > room:
            body, data, at = body + data, struct.pack(order + wide, at), at + len(data)
        entries.append(struct.pack(f"{order}HH{wide}", tag, c, len(values)) + data.ljust(room, b"\0"))
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    with open(path, "wb") as out:
        out.write(start + body + struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + struct.pack(order + wide, 0))


@pytest.mark.parametrize("layout", [{}, {"big": True}, {"order": ">"}, {"chunky": True}, {"predictor": 2}, {"chunky": True, "predictor": 2, "order": ">"}, {"strips": 7}, {"strips": 7, "chunky": True, "compression": 1}])
@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
def test_files_of_other_layouts(tmp_path, layout, dtype):
    image = np.random.default_rng(5).integers(0, np.iinfo(dtype).max, (3, 37, 41)).astype(dtype)
    plain_tiff(tmp_path / "x.tif", image, **layout)
    reader = geotiff.Reader(str(tmp_path / "x.tif"))
    assert reader.grid == geotiff.Grid(10.0, 500.0, 900.0, 41, 37, 32631)
    assert (reader.window(0, 0, 37, 41) == image).all()
    edge = reader.window(30, 35, 12, 12)
    assert (edge[:, :7, :6] == image[:, 30:, 35:]).all() and not edge[:, 7:].any()
    assert (reader.decimated(18, 20) == image[:, np.arange(18) * 37 // 18][:, :, np.arange(20) * 41 // 20]).all()


def test_a_file_that_is_none(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no such thing at all, of course")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.Reader(str(tmp_path / "a.tif"))
    image = np.zeros((1, 4, 4), np.uint8)
    plain_tiff(tmp_path / "b.tif", image, compression=5)
    with pytest.raises(ValueError, match="not supported"):
        geotiff.Reader(str(tmp_path / "b.tif"))
    assert geotiff.scaled(geotiff.Grid(10.0, 0.0, 0.0, 100, 100, 32631), 50, 50).res == 20.0


@pytest.mark.parametrize("method", ["average", "bilinear", "cubic", "lanczos"])
def test_windows_of_finer_files_are_smoothed(tmp_path, method):
    image = (1000 + 100 * (np.indices((64, 64)).sum(axis=0) % 2))[None].astype(np.uint16)  # a chequerboard
    geotiff.write(str(tmp_path / "x.tif"), [(0, 0, image)], geotiff.Grid(10.0, 0.0, 640.0, 64, 64, 32631), 1, tile=64)
    reader = geotiff.Reader(str(tmp_path / "x.tif"))
    got = assets.window_on(reader, geotiff.Grid(40.0, 0.0, 640.0, 16, 16, 32631), 0, 0, 16, 16, method)[0]
    assert (abs(got[4:-4, 4:-4].astype(int) - 1050) <= 12).all()
    same = assets.window_on(reader, reader.grid, 5, 6, 7, 8, method)[0]
    assert (same == image[0, 5:12, 6:14]).all()


def test_addresses_are_signed_again(tmp_path):
    now, asked = [0.0], []

    def sign(href):
        asked.append(href)
        return f"{href}?{len(asked)}"

    known = assets.SignedAddresses(sign, ttl=10, clock=lambda: now[0])
    assert [known("a"), known("a")] == ["a?1", "a?1"]
    now[0] = 11.0
    assert known("a") == "a?2"
    assert assets.with_token("sig=1")("x?y=2") == "x?y=2&sig=1" and assets.unsigned("x") == "x"
    opened, calls = [], []

    class Fake:
        def __init__(self, href):
            opened.append(href)

        def close(self):
            opened.append("closed")

    def read(reader):
        calls.append(reader)
        if len(calls) == 1:
            raise OSError("expired")
        return np.ones(1)

    handles = assets.Handles(sign, most=1, open_with=Fake)
    assert handles.read("b", read, sleep=lambda s: None)[0] == 1 and opened == ["b?3", "closed", "b?4"]
    handles.get("c")
    assert opened[-2:] == ["c?5", "closed"]


def test_network_defaults_leave_no_trace():
    environ = {"AWS_MAX_ATTEMPTS": "9"}
    with assets.network_defaults(environ):
        assert environ["AWS_MAX_ATTEMPTS"] == "9" and environ["AWS_RETRY_MODE"] == "standard"
    assert environ == {"AWS_MAX_ATTEMPTS": "9"}
    off = {assets.NO_DEFAULTS: "1"}
    with assets.network_defaults(off):
        assert off == {assets.NO_DEFAULTS: "1"}


def test_public_names():
    assert skyloom.mosaic is front.mosaic and skyloom.SOURCE_AWS == "AWS" and issubclass(skyloom.SceneFetchError, RuntimeError)
    skyloom.set_log_level("info")
    with pytest.raises(AttributeError):
        skyloom.nothing  # noqa: B018
