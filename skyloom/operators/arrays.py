"""Masks and coverage of one packed tile, in numpy; the same rules as the pixel operators."""

from __future__ import annotations

import numpy as np

from .coverage import Ring, row_spans
from .masks import CLOUDY_CLASSES, GROWTH, NO_DATA_CLASS

#: Offsets of the four and of the eight neighbours.
CROSS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def shifted(a: np.ndarray, dy: int, dx: int, fill: bool = False) -> np.ndarray:
    """The array moved by an offset; what comes in from outside is ``fill``."""
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(a: np.ndarray, steps: int = GROWTH) -> np.ndarray:
    """Cross dilations; nothing grows in from outside."""
    for _ in range(steps):
        a = a | shifted(a, 0, 1) | shifted(a, 0, -1) | shifted(a, 1, 0) | shifted(a, -1, 0)
    return a


def scl_valid(classes: np.ndarray, steps: int = GROWTH) -> np.ndarray:
    """Clear and not near no-data."""
    return ~np.isin(classes, CLOUDY_CLASSES) & ~dilate(classes == NO_DATA_CLASS, steps)


def band_valid(bands: np.ndarray, steps: int = GROWTH) -> np.ndarray:
    """Not near a pixel whose bands sum to zero."""
    return ~dilate(bands.astype(np.int64).sum(axis=0) == 0, steps)


def regions(a: np.ndarray) -> np.ndarray:
    """Number of the four-connected region of every set pixel, by its first pixel (0: not set)."""
    label = np.where(a, np.arange(1, a.size + 1).reshape(a.shape), 0)
    while True:
        best = np.where(a, label, a.size + 1)
        for dy, dx in CROSS:
            near = np.full_like(best, a.size + 1)
            h, w = a.shape
            near[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = best[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
            best = np.minimum(best, near)
        new = np.where(a, best, 0)
        # jump to the label that the label's own pixel has
        flat = new.ravel()
        jumped = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0).reshape(a.shape)
        if (jumped == label).all():
            return label
        label = jumped


def without_islands(a: np.ndarray, least: int) -> np.ndarray:
    """Regions of fewer than ``least`` pixels take the other value, set ones first."""
    for value in (True, False):
        of = regions(a == value)
        size = np.bincount(of.ravel(), minlength=a.size + 1)
        small = (of > 0) & (size[of] < least)
        a = np.where(small, not value, a)
    return a


def smooth(a: np.ndarray, steps: int) -> np.ndarray:
    """Opened, then closed, by crosses."""
    erode = lambda x: ~dilate(~x, steps)
    return erode(dilate(dilate(erode(a), steps), steps))


def class_clear(classes: np.ndarray, least: int = 8, edge: int = 3) -> np.ndarray:
    """Clear places (class 0) of a classifier, without small islands and rough edges."""
    return smooth(without_islands(classes == 0, least), edge)


def touched(ring: Ring, row: int, col: int, height: int, width: int) -> np.ndarray:
    """Pixels of a window that a ring's area or boundary touches (pixel coordinates)."""
    out = np.zeros((height, width), bool)
    local = [(x - col, y - row) for x, y in ring]
    for r, first, last in row_spans([[local]], height, width):
        out[r, first : last + 1] = True
    x0, y0 = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    for (ax, ay), (bx, by) in zip(local, [*local[1:], local[0]], strict=True):
        r0, r1 = max(0, int(np.floor(min(ay, by))) - 1), min(height, int(np.ceil(max(ay, by))) + 1)
        c0, c1 = max(0, int(np.floor(min(ax, bx))) - 1), min(width, int(np.ceil(max(ax, bx))) + 1)
        if r0 >= r1 or c0 >= c1:
            continue
        x, y = x0[r0:r1, c0:c1], y0[r0:r1, c0:c1]
        near = (x + 1 >= min(ax, bx)) & (x <= max(ax, bx)) & (y + 1 >= min(ay, by)) & (y <= max(ay, by))
        sides = [(bx - ax) * (v - ay) - (by - ay) * (u - ax) for u, v in ((x, y), (x, y + 1), (x + 1, y), (x + 1, y + 1))]
        one_side = np.all([s > 0 for s in sides], axis=0) | np.all([s < 0 for s in sides], axis=0)
        out[r0:r1, c0:c1] |= near & ~one_side
    return out


def counted(shapes: list[list[list[Ring]]], row: int, col: int, height: int, width: int) -> np.ndarray:
    """How many shapes (polygons of rings, pixel coordinates) hold each pixel's centre."""
    out = np.zeros((height, width), np.int32)
    for shape in shapes:
        local = [[[(x - col, y - row) for x, y in ring] for ring in rings] for rings in shape]
        for r, first, last in row_spans(local, height, width):
            out[r, first : last + 1] += 1
    return out


def context(offset: int, size: int, least: int = 100) -> tuple[int, int, int]:
    """A side padded to ``least``: new offset, new size, and where the old one begins in it."""
    extra = max(0, least - size)
    return offset - extra // 2, size + extra, extra // 2
