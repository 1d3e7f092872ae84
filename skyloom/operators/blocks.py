"""Packed tiles: one row for each (scene, tile) with its pixels as binary blocks.

For rasters of full size a row for each pixel is too much; here a block is
``mask`` (bits of row, column) and ``bands`` (of each pixel that the mask has, in
order, the bands as uint16), and a
reducer sees the blocks of one tile in rank order.  Results equal those of the
pixel reducers.  Memory of a task is one tile's stack, as deep as the pixel with
most observations where most scenes show little of the tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "scene bigint, rank bigint, r bigint, c bigint, h bigint, w bigint, bands binary, mask binary"
TILE_SCHEMA = "r bigint, c bigint, h bigint, w bigint, bands binary, n binary"
#: Mask bits that are set out at once, and pixels of a batch, about.
MASK_PIXELS, BATCH_PIXELS = 1 << 24, 100_000
#: A stack is moved together if so many times the pixels seen are not more than those it has room for.
SPARSE = 4


def pack(bands: np.ndarray, mask: np.ndarray) -> tuple[bytes, bytes]:
    mask = mask.astype(bool)
    return bands[:, mask].T.astype("<u2").tobytes(), np.packbits(mask).tobytes()


def unpack(bands: bytes, mask: bytes, k: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Bands (zero where the mask has no pixel) and mask of a block."""
    seen = np.unpackbits(np.frombuffer(mask, np.uint8), count=h * w).reshape(h, w).view(bool)
    out = np.zeros((k, h, w), np.uint16)
    out[:, seen] = np.frombuffer(bands, "<u2").reshape(-1, k).T
    return out, seen


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes that stand in ``data`` one after the other."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8).ravel())])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    parts = []
    for c in column.chunks:
        offsets, data = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1], c.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8))
    return np.concatenate(parts)


def from_pixels(obs: DataFrame, bands: Sequence[str], size: int, height: int, width: int) -> DataFrame:
    """Blocks of an observation table (scene, rank, row, col, bands)."""
    tiled = obs.select(F.col("scene").cast("bigint").alias("scene"), F.col("rank").cast("bigint").alias("rank"), (F.col("row") - F.col("row") % size).alias("r"), (F.col("col") - F.col("col") % size).alias("c"), "row", "col", *bands)
    key = ["scene", "r", "c"]

    def packed(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """The blocks that begin at these rows."""
        scene, rank, r, c = (rows[x].to_numpy()[first] for x in ("scene", "rank", "r", "c"))
        h, w = np.minimum(size, height - r), np.minimum(size, width - c)
        block = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
        y, x = rows["row"].to_numpy() - r[block], rows["col"].to_numpy() - c[block]
        if (y >= h[block]).any() or (x >= w[block]).any():
            raise IndexError("a pixel is outside the raster")
        at = y * w[block] + x
        order = np.lexsort((at, block))
        at, block = at[order], block[order]
        last = np.append((at[1:] != at[:-1]) | (block[1:] != block[:-1]), True)  # of a pixel that is there twice, one row
        order, at, block = order[last], at[last], block[last]
        values = np.column_stack([rows[b].to_numpy()[order].astype(np.uint16) for b in bands]) if bands else np.zeros((len(order), 0), np.uint16)
        ends = np.cumsum(np.bincount(block, minlength=len(first)))
        masks, of = [], []
        for shape in np.unique(np.column_stack((h, w)), axis=0):  # at most four
            here, area = np.flatnonzero((h == shape[0]) & (w == shape[1])), int(shape[0] * shape[1])
            step = max(1, MASK_PIXELS // area)
            for some in (here[i : i + step] for i in range(0, len(here), step)):
                count = np.diff(np.concatenate(([0], ends)))[some]
                own = np.repeat(ends[some] - np.cumsum(count), count) + np.arange(count.sum())
                bits = np.zeros((len(some), area), bool)
                bits[np.repeat(np.arange(len(some)), count), at[own]] = True
                masks.append(_binary(np.packbits(bits, axis=1), np.full(len(some), -(-area // 8))))
                of.append(some)
        mask = pa.concat_arrays(masks).take(pa.array(np.argsort(np.concatenate(of))))
        pixels = _binary(values.astype("<u2"), np.diff(ends, prepend=0) * 2 * len(bands))
        return pa.RecordBatch.from_arrays([*map(pa.array, (scene, rank, r, c, h, w)), pixels, mask], ["scene", "rank", "r", "c", "h", "w", "bands", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None  # the last block of a batch may go on in the next one
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if carried is None else pa.concat_tables([carried, rows])
            if not rows.num_rows:
                continue
            first = _starts([rows[x].to_numpy() for x in key])
            if len(first) > 1:
                yield packed(rows.slice(0, first[-1]), first[:-1])
            carried = rows.slice(first[-1])
        if carried is not None:
            yield packed(carried, np.zeros(1, np.int64))

    return tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, BLOCK_SCHEMA)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """First rows of the runs of equal values."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(change)


def _valid(stack: np.ndarray, masks: np.ndarray, zero_is_missing: bool = True) -> np.ndarray:
    """Masked pixels, less those that are zero in all of several bands if the all-zero rule holds."""
    return masks & (stack != 0).any(axis=1) if zero_is_missing and stack.shape[1] > 1 else masks


def _cap(valid: np.ndarray, limit: int | None) -> np.ndarray:
    return valid if limit is None else valid & (np.cumsum(valid, axis=0) <= limit)


def reduce_mean(stack: np.ndarray, valid: np.ndarray) -> np.ndarray:
    total = np.zeros(stack.shape[1:], np.int64)
    for scene, ok in zip(stack, valid, strict=True):
        total += scene * ok
    n = valid.sum(axis=0)
    return np.where(n > 0, total // np.maximum(n, 1), 0)


def reduce_first(stack: np.ndarray, valid: np.ndarray) -> np.ndarray:
    at = valid.argmax(axis=0)
    got = np.take_along_axis(stack, at[None, None], axis=0)[0]
    return np.where(valid.any(axis=0), got, 0)


def _ordered(stack: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Values in order, what is not valid last: only places below the count are ever read, so the largest value may mark it."""
    return np.sort(np.where(valid[:, None], stack, np.uint16(65535)), axis=0)


def reduce_percentile(stack: np.ndarray, valid: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation at a single-precision position, truncated."""
    n = valid.sum(axis=0)
    ordered = _ordered(stack, valid)
    pos = np.float32(q / 100) * np.maximum(n - 1, 0).astype(np.float32)
    lo, hi = np.floor(pos).astype(np.int64), np.ceil(pos).astype(np.int64)
    a = np.take_along_axis(ordered, np.broadcast_to(lo, (1, stack.shape[1], *lo.shape)), axis=0)[0]
    b = np.take_along_axis(ordered, np.broadcast_to(hi, (1, stack.shape[1], *hi.shape)), axis=0)[0]
    a, b = np.where(n > 0, a, 0).astype(np.int64), np.where(n > 0, b, 0).astype(np.int64)
    return np.floor((a + (b - a) * (pos.astype(np.float64) - np.floor(pos))).astype(np.float32)).astype(np.int64)


def reduce_medoid(stack: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The scene nearest the doubled per-band medians, ties to the first."""
    n = valid.sum(axis=0)
    ordered = _ordered(stack, valid)
    shape = (1, stack.shape[1], *n.shape)
    low = np.take_along_axis(ordered, np.broadcast_to(np.maximum(n - 1, 0) // 2, shape), axis=0)[0]
    high = np.take_along_axis(ordered, np.broadcast_to(np.minimum(n // 2, len(stack) - 1), shape), axis=0)[0]
    target = np.where(n > 0, low.astype(np.int64) + high, 0)
    best, at = np.full(n.shape, np.iinfo(np.int64).max), np.zeros(n.shape, np.int64)
    for i, (scene, ok) in enumerate(zip(stack, valid, strict=True)):  # one scene at a time is widened
        distance = ((2 * scene.astype(np.int64) - target) ** 2).sum(axis=0)
        nearer = ok & (distance < best)
        best[nearer], at[nearer] = distance[nearer], i
    return np.where(n > 0, np.take_along_axis(stack, at[None, None], axis=0)[0], 0)


def stop_early(valid: np.ndarray, covered: np.ndarray, least: int) -> np.ndarray:
    """Scenes after the one that gives every covered pixel ``least`` observations are left out."""
    enough = ((np.cumsum(valid, axis=0) >= least) | ~covered).all(axis=(1, 2))
    if enough.any():
        valid = valid.copy()
        valid[int(enough.argmax()) + 1 :] = False
    return valid


def _together(group: pa.Table, masks: np.ndarray, k: int, covered: np.ndarray, least: int | None, zero_is_missing: bool) -> tuple[np.ndarray, np.ndarray]:
    """The stack of a tile without what is not valid: each pixel's valid observations in rank order from the bottom
    on, and which places are filled.  ``least``: the early stop, if there is one."""
    h, w = covered.shape
    scene, pixel = np.nonzero(masks)
    values = _bytes(group["bands"]).view("<u2").reshape(-1, k)
    keep = covered.ravel()[pixel]
    if zero_is_missing and k > 1:
        keep &= (values != 0).any(axis=1)
    scene, pixel, values = scene[keep], pixel[keep], values[keep]
    order = np.argsort(pixel.astype(np.uint16) if h * w <= 1 << 16 else pixel, kind="stable")
    scene, pixel, values = scene[order], pixel[order], values[order]
    n = np.bincount(pixel, minlength=h * w)
    begin = np.cumsum(n) - n
    depth = np.arange(len(pixel)) - np.repeat(begin, n)
    if least is not None and covered.any() and (n[covered.ravel()] >= least).all():
        cut = scene[begin[covered.ravel()] + least - 1].max() if least > 0 else 0
        keep = scene <= cut
        pixel, values, depth = pixel[keep], values[keep], depth[keep]
        n = np.bincount(pixel, minlength=h * w)
    deep = max(1, int(n.max()))
    stack = np.zeros((deep, k, h * w), np.uint16)
    stack[depth, :, pixel] = values
    return stack.reshape(deep, k, h, w), (np.arange(deep)[:, None] < n).reshape(deep, h, w)


def mosaic(blocks: DataFrame, bands: int, method: str, *, percentile: float | None = None, max_observations: int | None = None, min_observations: int | None = None, cover: DataFrame | None = None, zero_is_missing: bool = True) -> DataFrame:
    """One packed tile (bands, and counts n as uint16) for every tile of the blocks.

    ``cover`` (r, c, cover: bits of the pixels that count; none: all) restricts pixels.  Scenes after
    the one that gives every such pixel ``min_observations`` are left out; with both counts only the cap holds.
    """
    if method not in ("mean", "first", "percentile", "median", "medoid"):
        raise ValueError(f"Invalid mosaic method: {method}. Must be of mean, first, percentile, median, medoid")
    q, whole = 50.0 if method == "median" else percentile, cover is None

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        r, c, h, w = (group[x][0].as_py() for x in ("r", "c", "h", "w"))
        covered = np.ones((h, w), bool) if whole else np.unpackbits(np.frombuffer(group["cover"][0].as_py() or b"", np.uint8), count=h * w).reshape(h, w).view(bool)
        masks = np.unpackbits(_bytes(group["mask"]).reshape(group.num_rows, -1), axis=1, count=h * w).view(bool)
        least = min_observations if max_observations is None and method != "first" else None
        if SPARSE * np.count_nonzero(masks) <= masks.size:
            stack, valid = _together(group, masks, bands, covered, least, zero_is_missing)
        else:
            stack = np.stack([unpack(b, m, bands, h, w)[0] for b, m in zip(group["bands"].to_pylist(), group["mask"].to_pylist(), strict=True)])
            valid = _valid(stack, masks.reshape(-1, h, w), zero_is_missing) & covered
            valid = valid if least is None else stop_early(valid, covered, least)
        if method != "first":
            valid = _cap(valid, max_observations)
        if method == "mean":
            out = reduce_mean(stack, valid)
        elif method == "first":
            out = reduce_first(stack, valid)
        elif method == "medoid":
            out = reduce_medoid(stack, valid)
        else:
            out = reduce_percentile(stack, valid, float(q))
        n = valid.any(axis=0).astype(int) if method == "first" else valid.sum(axis=0)
        return pa.table({"r": [r], "c": [c], "h": [h], "w": [w], "bands": pa.array([np.clip(out, 0, 65535).astype("<u2").tobytes()], pa.binary()), "n": pa.array([n.astype("<u2").tobytes()], pa.binary())})

    if cover is not None:
        blocks = blocks.join(cover, ["r", "c"])
    return blocks.groupBy("r", "c").applyInArrow(run, TILE_SCHEMA)


def to_pixels(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """row, col, bands, n of the observed pixels of packed tiles."""
    names = ["row", "col", *bands, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for r, c, h, w, data, n in zip(*(b.column(x).to_pylist() for x in ("r", "c", "h", "w", "bands", "n")), strict=True):
                values, count = np.frombuffer(data, "<u2").reshape(len(bands), h, w), np.frombuffer(n, "<u2").reshape(h, w)
                y, x = np.nonzero(count)
                parts.append(np.vstack((y + r, x + c, values[:, y, x].astype(np.int64), count[y, x].astype(np.int64)[None])))
                size += len(y)
                if size >= BATCH_PIXELS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.hstack(parts)], names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.hstack(parts)], names)

    return tiles.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def to_array(tiles: DataFrame, bands: int, height: int, width: int) -> np.ndarray:
    """The whole raster (bands, height, width) on the driver, tile by tile."""
    out = np.zeros((bands, height, width), np.uint16)
    for t in tiles.toLocalIterator():
        out[:, t.r : t.r + t.h, t.c : t.c + t.w] = np.frombuffer(t.bands, "<u2").reshape(bands, t.h, t.w)
    return out
