"""STAC items, retries and reads across zones."""

from __future__ import annotations

import json

import pytest

from skyloom.functions import geo
from skyloom.operators import warp
from skyloom.sources import catalog, retry, stac
from skyloom.sources.geotiff import Grid

ITEMS = {
    "type": "FeatureCollection",
    "features": [
        {"id": "a", "bbox": [115, -32, 116, -31], "geometry": {"type": "Polygon", "coordinates": [[[115, -32], [116, -32], [116, -31], [115, -32]]]}, "properties": {"datetime": "2023-06-01T02:00:00Z", "s2:mgrs_tile": "50HMH", "sat:relative_orbit": 60, "eo:cloud_cover": 12.5, "proj:epsg": 32750}, "assets": {"B04": {"href": "x", "proj:transform": [10, 0, 399960, 0, -10, 6500020]}}},
        {"id": "b", "bbox": [115, -32, 116, -31], "geometry": None, "properties": {"datetime": "2023-06-03T02:00:00Z", "grid:code": "MGRS-50HMH", "s2:product_uri": "S2A_R061_T50HMH_x", "proj:code": "EPSG:32750", "eo:cloud_cover": 90}, "assets": {}},
        {"id": "c", "bbox": [1, 2, 3, 4], "geometry": None, "properties": {"datetime": "2023-06-05T02:00:00Z"}, "assets": {}},
    ],
}


def test_items(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(ITEMS))
    table = stac.scenes(stac.read_items(spark, str(tmp_path)))
    rows = {r.scene_id: r for r in table.collect()}
    assert [(rows[k].tile, rows[k].orbit, rows[k].epsg) for k in "abc"] == [("50HMH", 60, 32750), ("50HMH", 61, 32750), (None, 0, None)]
    assert (rows["a"].origin_x, rows["a"].origin_y, rows["b"].origin_x) == (399960, 6500020, None)
    assert {r.scene_id for r in stac.where_properties(table, {"eo:cloud_cover": {"lt": 80}}).collect()} == {"a"}
    assert catalog.get_source("AWS").asset("B04") == "red" and catalog.get_source("AWS").asset("visual") == "visual"
    assert catalog.get_source("AWS").largest_block(["B04", "SCL"]) == 1024 and catalog.get_source("MPC").largest_block([]) == 512
    assert catalog.get_source("AWS").tile_filter("5HMK")["mgrs:utm_zone"] == {"eq": 5}
    with pytest.raises(ValueError, match="Invalid source"):
        catalog.get_source("X")


def test_retries(capsys):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return 7

    assert retry.retried(flaky, sleep=lambda s: None) == 7 and len(calls) == 3
    with pytest.raises(KeyError):
        retry.retried(lambda: {}["x"], sleep=lambda s: None)
    with pytest.raises(retry.SceneFetchError) as e:
        retry.fetch_scene("s1", lambda: (_ for _ in ()).throw(OSError("gone")), sleep=lambda s: None)
    assert retry.report_dropped([e.value]) == [{"id": "s1", "reason": "OSError: gone"}] and "s1" in capsys.readouterr().err
    assert all(0.75 * min(8, 0.5 * 2**n) <= retry.backoff(n) <= 1.25 * min(8, 0.5 * 2**n) for n in range(8))


def test_reads_across_zones(spark):
    x, y = geo.forward(6.01, 45.0, 31)
    source = Grid(100.0, x - 2000, y + 2000, 40, 40, 32631)
    x, y = geo.forward(6.01, 45.0, 32)
    target = Grid(100.0, x - 500, y + 500, 10, 10, 32632)
    pixels = spark.range(1600).selectExpr("1 as scene", "id div 40 as row", "id % 40 as col", "id as b")
    grid = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col")
    got = {(r.row, r.col): (r.b // 40, r.b % 40) for r in warp.nearest(grid, target, pixels, source, ["scene"], ["b"]).collect()}
    assert len(got) == 100 and got[5, 5][0] in (19, 20, 21) and got[5, 5][1] in (19, 20, 21)
    same = warp.nearest(grid, Grid(100.0, source.minx, source.maxy, 10, 10, 32631), pixels, source, ["scene"], ["b"])
    assert {(r.row, r.col, r.b) for r in same.collect()} == {(i, j, 40 * i + j) for i in range(10) for j in range(10)}
    with pytest.raises(ValueError, match="not supported"):
        warp.reproject(grid.row, grid.col, 4326, 32631)
