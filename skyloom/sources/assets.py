"""Reads of scene assets inside tasks: signed addresses, open files kept, windows on any grid."""

from __future__ import annotations

import os
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, MutableMapping
from contextlib import contextmanager
from dataclasses import replace

import numpy as np

from ..functions.geo import transform
from .geotiff import Grid, Image, Reader
from .retry import retried

#: Seconds for which a signed address is used, and files that a task keeps open.
SIGNED_FOR = 45 * 60
MOST_OPEN = 64

#: What file systems are told unless the environment says otherwise, and the variable that forbids it.
NETWORK_DEFAULTS = {"AWS_RETRY_MODE": "standard", "AWS_MAX_ATTEMPTS": "4", "AWS_EC2_METADATA_DISABLED": "true"}
NO_DEFAULTS = "SKYLOOM_NO_NETWORK_DEFAULTS"

Sign = Callable[[str], str]


@contextmanager
def network_defaults(environ: MutableMapping[str, str] = os.environ) -> Iterator[None]:
    """The defaults for as long as a task reads; what was set before stays, and is as before afterwards."""
    added = [] if environ.get(NO_DEFAULTS) else [k for k in NETWORK_DEFAULTS if k not in environ]
    environ.update({k: NETWORK_DEFAULTS[k] for k in added})
    try:
        yield
    finally:
        for k in added:
            environ.pop(k, None)


def unsigned(href: str) -> str:
    return href


def with_token(token: str) -> Sign:
    """A signer that adds a query string, as shared access signatures are used."""

    def sign(href: str) -> str:
        return href if token in href else f"{href}{'&' if '?' in href else '?'}{token}"

    return sign


class SignedAddresses:
    """Signed forms of addresses, renewed after ``ttl`` seconds."""

    def __init__(self, sign: Sign, ttl: float = SIGNED_FOR, clock: Callable[[], float] = time.monotonic):
        self.sign, self.ttl, self.clock = sign, ttl, clock
        self.known: dict[str, tuple[float, str]] = {}

    def __call__(self, href: str) -> str:
        at, signed = self.known.get(href, (None, ""))
        if at is None or self.clock() - at >= self.ttl:
            signed = self.sign(href)
            self.known[href] = (self.clock(), signed)
        return signed

    def forget(self, href: str) -> None:
        self.known.pop(href, None)


def open_address(address: str) -> Reader:
    """A reader of a local path or of any address that Arrow's file systems know."""
    if "://" not in address:
        return Reader(address)
    if address.startswith("file://"):
        return Reader(address.removeprefix("file://"))
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(address)
    stream = fs.open_input_file(path)
    return Reader(address, lambda offset, size: stream.read_at(size, offset))


class Handles:
    """Readers that stay open while a task uses them, the least recently used closed first."""

    def __init__(self, sign: Sign = unsigned, most: int = MOST_OPEN, open_with: Callable[[str], Reader] = open_address):
        self.addresses, self.most, self.open_with = SignedAddresses(sign), most, open_with
        self.readers: OrderedDict[str, Reader] = OrderedDict()

    def get(self, href: str) -> Reader:
        if href not in self.readers:
            self.readers[href] = self.open_with(self.addresses(href))
            if len(self.readers) > self.most:
                self.readers.popitem(last=False)[1].close()
        self.readers.move_to_end(href)
        return self.readers[href]

    def reopen(self, href: str) -> None:
        """Forget the reader and the signature of an address."""
        self.addresses.forget(href)
        if (reader := self.readers.pop(href, None)) is not None:
            reader.close()

    def close(self) -> None:
        while self.readers:
            self.readers.popitem()[1].close()

    def read(self, href: str, window: Callable[[Reader], np.ndarray], attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> np.ndarray:
        """``window`` of the reader; after a failure it is opened and signed again."""
        return retried(lambda: window(self.get(href)), attempts, reopen=lambda: self.reopen(href), sleep=sleep)


def _weights(method: str, away: np.ndarray) -> np.ndarray:
    a = np.abs(away)
    if method == "average":
        return (a <= 0.5).astype(float)
    if method == "bilinear":
        return np.maximum(0.0, 1 - a)
    if method == "cubic":
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))
    if method == "lanczos":
        return np.where(a < 3, np.sinc(a) * np.sinc(a / 3), 0.0)
    raise ValueError(f"Invalid resampling method: {method}")


REACH = {"average": 0.5, "bilinear": 1, "cubic": 2, "lanczos": 3}


def _source_window(reader: Reader, image: Image, y0: int, x0: int, y1: int, x1: int) -> tuple[np.ndarray, int, int]:
    """The part of a window that lies in the image, and where it begins."""
    y0, x0, y1, x1 = max(0, y0), max(0, x0), min(image.height, y1), min(image.width, x1)
    if y1 <= y0 or x1 <= x0:
        return np.zeros((image.bands, 0, 0), image.dtype), 0, 0
    return reader.window(y0, x0, y1 - y0, x1 - x0, image), y0, x0


def window_on(reader: Reader, target: Grid, row: int, col: int, height: int, width: int, method: str = "nearest") -> np.ndarray:
    """Bands of a window of ``target``, whatever the grid and system of the file.

    Every target pixel's centre finds its place in the file; places outside read 0.
    Weights of taps that are not in the file are left out; kernels widen where the
    file is finer than the target.
    """
    image, grid = reader.level_for(target.res if reader.grid.epsg == target.epsg else 0.0)
    x, y = np.meshgrid(target.minx + (col + np.arange(width) + 0.5) * target.res, target.maxy - (row + np.arange(height) + 0.5) * target.res)
    east, north = transform(x, y, target.epsg, grid.epsg)
    sx, sy = (east - grid.minx) / grid.res, (grid.maxy - north) / grid.res
    if method == "nearest":
        iy, ix = np.floor(sy).astype(np.int64), np.floor(sx).astype(np.int64)
        data, y0, x0 = _source_window(reader, image, int(iy.min()), int(ix.min()), int(iy.max()) + 1, int(ix.max()) + 1)
        out = np.zeros((image.bands, height, width), image.dtype)
        if data.size:
            ok = (iy >= y0) & (iy < y0 + data.shape[1]) & (ix >= x0) & (ix < x0 + data.shape[2])
            out[:, ok] = data[:, iy[ok] - y0, ix[ok] - x0]
        return out
    # source pixels of one target pixel; kernels are not narrowed
    step = lambda a, axis: float(np.abs(np.diff(a, axis=axis)).mean()) if a.shape[axis] > 1 else target.res / grid.res
    wide_y, wide_x = max(1.0, step(sy, 0)), max(1.0, step(sx, 1))
    reach_y, reach_x = int(np.ceil(REACH[method] * wide_y)), int(np.ceil(REACH[method] * wide_x))
    iy, ix = np.floor(sy - 0.5).astype(np.int64), np.floor(sx - 0.5).astype(np.int64)
    data, y0, x0 = _source_window(reader, image, int(iy.min()) - reach_y, int(ix.min()) - reach_x, int(iy.max()) + reach_y + 2, int(ix.max()) + reach_x + 2)
    total, weight = np.zeros((image.bands, height, width)), np.zeros((height, width))
    if data.size:
        for dy in range(1 - reach_y, reach_y + 1):
            wy = _weights(method, (sy - (iy + dy + 0.5)) / wide_y)
            for dx in range(1 - reach_x, reach_x + 1):
                at_y, at_x = iy + dy - y0, ix + dx - x0
                ok = (at_y >= 0) & (at_y < data.shape[1]) & (at_x >= 0) & (at_x < data.shape[2])
                w = np.where(ok, wy * _weights(method, (sx - (ix + dx + 0.5)) / wide_x), 0.0)
                weight += w
                total += w * data[:, np.where(ok, at_y, 0), np.where(ok, at_x, 0)]
    inside = (sy >= 0) & (sy < image.height) & (sx >= 0) & (sx < image.width) & (weight > 1e-9)
    limits = np.iinfo(image.dtype)
    return np.where(inside, np.clip(np.floor(total / np.where(inside, weight, 1.0) + 0.5), limits.min, limits.max), 0).astype(image.dtype)


def coarser(grid: Grid, res: float) -> Grid:
    """The grid of the same area with pixels of about ``res`` (at least one)."""
    size = lambda n: max(1, round(n * grid.res / res))
    return replace(grid, res=grid.res * grid.width / size(grid.width), width=size(grid.width), height=size(grid.height))
