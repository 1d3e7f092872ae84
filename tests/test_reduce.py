"""Reducers on small stacks with known answers, and random stacks against numpy."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import blocks, reduce, tiles
from skyloom.plans import catalogue


def stack_rows(values, masks):
    """(scene, rank, row, col, bands) rows of stack[scene, band, y, x]."""
    rows = []
    for s in range(values.shape[0]):
        for y, x in zip(*np.nonzero(masks[s]), strict=True):
            rows.append((s, s, int(y), int(x), *[int(v) for v in values[s, :, y, x]]))
    return rows


def frame(spark, values, masks):
    bands = [f"b{i}" for i in range(values.shape[1])]
    schema = "scene long, rank long, row long, col long, " + ", ".join(f"{b} long" for b in bands)
    return spark.createDataFrame(stack_rows(values, masks), schema), bands


def collected(df, bands):
    return {(r.row, r.col): tuple(r[b] for b in bands) for r in df.collect()}


def constant(levels, bands=1, shape=(5, 7)):
    return np.stack([np.full((bands, *shape), v) for v in levels]), np.ones((len(levels), *shape), bool)


def test_mean_is_floor_and_zero_spectrum_is_missing(spark):
    values, masks = constant([10, 31], bands=3)
    values[0, :, :, 0] = 0
    obs, bands = frame(spark, values, masks)
    got = collected(reduce.mosaic(obs, ["row", "col"], bands, "mean"), bands)
    assert got[0, 0] == (31, 31, 31) and got[0, 1] == (20, 20, 20)


#: scene, price, discount, tax of three lines; the second has zeros in all bands
ZEROS = [(1, 1000.0, 0.05, 0.05), (2, 10000.0, 0.0, 0.0), (3, 3000.0, 0.07, 0.02)]


@pytest.mark.parametrize("name", sorted(n for n in catalogue.SQL if re.match("mosaic_|blocks_|aoi_|output_", n)))
def test_an_observation_of_zeros_counts_as_in_the_sql(spark, tmp_path, name):
    """One pixel, three scenes; the second shows zeros in all bands."""
    rows = [(12 * k + 3, 55, k, 1, 1.0, *bands) for k, *bands in ZEROS]  # orders whose line 1 has class 4
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k) for k in range(1, 4)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, 30) for k in (55, 260)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "supplier", "part"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = db.execute(catalogue.SQL[name])
    header = [x[0] for x in theirs.description]
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(header).collect())) == sorted(theirs.fetchall())


def test_single_band_zero_is_data(spark):
    obs, bands = frame(spark, *constant([0, 20]))
    assert set(collected(reduce.mosaic(obs, ["row", "col"], bands, "mean"), bands).values()) == {(10,)}


def test_cap_counts_valid_observations_only(spark):
    obs, bands = frame(spark, *constant([0, 20, 40], bands=2))
    got = collected(reduce.mosaic(obs, ["row", "col"], bands, "mean", max_observations=2), bands)
    assert set(got.values()) == {(30, 30)}


def test_first_takes_next_valid(spark):
    values, masks = constant([10, 20, 30])
    masks[0] = False
    obs, bands = frame(spark, values, masks)
    assert set(collected(reduce.mosaic(obs, ["row", "col"], bands, "first"), bands).values()) == {(20,)}


def test_medoid_half_integer_target(spark):
    values = np.array([[0, 0], [0, 2], [0, 2], [1, 1]]).reshape(4, 2, 1, 1)
    obs, bands = frame(spark, values, np.ones((4, 1, 1), bool))
    assert collected(reduce.medoid(obs, ["row", "col"], bands), bands) == {(0, 0): (0, 2)}


def test_early_stop_waits_for_the_last_pixel(spark):
    values, masks = constant([0, 10, 20])
    masks[0, 0, 0] = False
    obs, bands = frame(spark, values, masks)
    grid = spark.createDataFrame([(y, x) for y in range(5) for x in range(7)], "row long, col long")
    one = lambda df: df.selectExpr("*", "0 as tr", "0 as tc")
    got = collected(reduce.median(reduce.stop_tiles(one(obs), one(grid), ["row", "col"], ["tr", "tc"], 2), ["row", "col"], bands), bands)
    assert got[0, 0] == (15,) and got[1, 1] == (10,)


def test_early_stop_needs_every_covered_pixel(spark):
    values, masks = constant([10, 20, 30])
    masks[:, 0, 0] = False
    obs, bands = frame(spark, values, masks)
    grid = spark.createDataFrame([(y, x) for y in range(5) for x in range(7)], "row long, col long")
    one = lambda df: df.selectExpr("*", "0 as tr", "0 as tc")
    got = collected(reduce.mean(reduce.stop_tiles(one(obs), one(grid), ["row", "col"], ["tr", "tc"], 2), ["row", "col"], bands), bands)
    assert set(got.values()) == {(20,)}


@pytest.mark.parametrize(("shape", "share"), [((1, 1, 3, 4), 0.7), ((5, 2, 4, 6), 0.8), ((17, 3, 5, 7), 0.35)])
def test_percentiles_of_random_stacks(spark, shape, share):
    rng = np.random.default_rng(7)
    values, masks = rng.integers(1, 12000, shape), rng.random((shape[0], *shape[2:])) < share
    obs, bands = frame(spark, values, masks)
    for q in (0, 10, 25, 50, 90, 100):
        got = collected(reduce.percentile(obs, ["row", "col"], bands, q), bands)
        for (y, x), v in got.items():
            want = np.quantile(values[masks[:, y, x], :, y, x], q / 100, axis=0)
            assert np.abs(np.array(v) - np.floor(want)).max() <= 1


@pytest.mark.parametrize("method", ["mean", "first", "median", "medoid"])
def test_blocks_equal_pixels(spark, method):
    rng = np.random.default_rng(3)
    values, masks = rng.integers(0, 6, (6, 3, 9, 11)), rng.random((6, 9, 11)) < 0.6
    obs, bands = frame(spark, values, masks)
    want = collected(reduce.mosaic(obs, ["row", "col"], bands, method, max_observations=4), bands)
    packed = blocks.from_pixels(obs, bands, 4, 9, 11)
    got = collected(blocks.to_pixels(blocks.mosaic(packed, 3, method, max_observations=4), bands), bands)
    assert got == want


@pytest.mark.parametrize("method", ["mean", "first", "median", "medoid"])
@pytest.mark.parametrize("options", [{}, {"max_observations": 2}, {"min_observations": 2}])
def test_sparse_blocks_equal_whole_stacks(spark, monkeypatch, method, options):
    """Many scenes that show little of a tile: packed small, and the same answers from stacks that are moved together."""
    rng = np.random.default_rng(4)
    values, masks = rng.integers(0, 4, (60, 3, 9, 11)), rng.random((60, 9, 11)) < 0.08
    obs, bands = frame(spark, values, masks)
    packed = blocks.from_pixels(obs, bands, 4, 9, 11)
    assert packed.selectExpr("sum(length(bands))").first()[0] == 6 * masks.sum()
    cover = blocks.from_pixels(obs.selectExpr("0 as scene", "0 as rank", "row", "col").where("row + col > 3").distinct(), [], 4, 9, 11).selectExpr("r", "c", "mask as cover")
    for more in ({}, {"cover": cover}):
        got = []
        for sparse in (1, 10**9):  # always, never
            monkeypatch.setattr(blocks, "SPARSE", sparse)
            got.append(sorted(map(tuple, blocks.to_pixels(blocks.mosaic(packed, 3, method, **options, **more), bands).collect())))
        assert got[0] == got[1] and got[0]


def test_empty_table(spark):
    obs = spark.createDataFrame([], "rank long, row long, col long, b0 long")
    for method in ("mean", "first", "median", "medoid"):
        assert reduce.mosaic(obs, ["row", "col"], ["b0"], method).count() == 0


@pytest.mark.parametrize(("length", "parts"), [(256, [256]), (512, [512]), (738, [512, 226]), (1024, [512, 512]), (1536, [1024, 512]), (2048, [1024, 1024])])
def test_aligned_split(spark, length, parts):
    assert tiles.split_length(length, 512) == parts
    assert spark.range(1).select(tiles.split_at(F.lit(length), 512).alias("x")).first().x == parts[0]


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="Invalid mosaic method"):
        reduce.mosaic(spark.createDataFrame([], "rank long, px long, b long"), ["px"], ["b"], "mode")
