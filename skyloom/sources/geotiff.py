"""A GeoTIFF reader and writer: tiled, 8 or 16 bit, deflate, north up.

Layout and tag numbers are those of the TIFF 6.0, BigTIFF and GeoTIFF documents.
The reader takes classic and big files of either byte order, tiles or strips, planes
apart or together, horizontal differences, overviews and an internal mask.  The writer
takes encoded blocks, so tasks can compress them; a file is written next to its
place and moved there when complete.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np

# Tag numbers, field types, and what some tags can say.
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, SAMPLES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 270, 277, 284, 317
STRIP_OFFSETS, STRIP_ROWS, STRIP_COUNTS, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 273, 278, 279, 322, 323, 324, 325
SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS = 339, 33550, 33922, 34735
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
REDUCED, MASK = 1, 4
_CRS_KEYS = (3072, 2048)


@dataclass(frozen=True)
class Grid:
    """North-up grid: resolution, left and top edge, size, EPSG code."""

    res: float
    minx: float
    maxy: float
    width: int
    height: int
    epsg: int


def _geo_keys(epsg: int) -> list[int]:
    geographic = epsg == 4326
    return [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]


def encode(block: np.ndarray, tile: int) -> bytes:
    """A block of one band as it stands in a file; boolean blocks are packed bits."""
    full = np.zeros((tile, tile), block.dtype.newbyteorder("<"))
    full[: block.shape[0], : block.shape[1]] = block
    return zlib.compress((np.packbits(full, axis=1) if full.dtype == bool else full).tobytes(), 6)


def place_of(row: int, col: int, grid: Grid, tile: int) -> int:
    """Number of the block that begins at a row and column."""
    if row % tile or col % tile:
        raise ValueError(f"piece at {row}, {col} is not at a multiple of {tile}")
    return row // tile * -(-grid.width // tile) + col // tile


def assemble(path: str, blocks: Iterable[tuple[int, int, bytes]], grid: Grid, bands: int, dtype: str = "uint16", tile: int = 256, names: list[str] | None = None, mask: bool = False) -> None:
    """Write encoded blocks (plane, number of the block, bytes); those not given are zero.

    Planes are separate, so a block is written as it comes.  Plane ``bands`` is the
    internal mask, if the file has one.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    per = -(-grid.width // tile) * -(-grid.height // tile)
    planes = bands + mask
    offsets, counts = np.zeros((planes, per), np.int64), np.zeros((planes, per), np.int64)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out:
            out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))

            def put(data: bytes) -> tuple[int, int]:
                at = out.tell()
                out.write(data)
                return at, len(data)

            for plane, number, data in blocks:
                offsets[plane, number], counts[plane, number] = put(data)
            for of, dtype_of in ((slice(0, bands), kind), (slice(bands, planes), np.dtype(bool))):
                if (gaps := counts[of] == 0).any():
                    offsets[of][gaps], counts[of][gaps] = put(encode(np.zeros((tile, tile), dtype_of), tile))
            size = {WIDTH: (4, [grid.width]), LENGTH: (4, [grid.height]), COMPRESSION: (3, [DEFLATE]), TILE_WIDTH: (4, [tile]), TILE_LENGTH: (4, [tile])}
            directories = [size | {
                BITS: (3, [kind.itemsize * 8] * bands), PHOTOMETRIC: (3, [1]), DESCRIPTION: (2, ("|".join(names or []) + "\0").encode()), SAMPLES: (3, [bands]), PLANAR: (3, [2]),
                TILE_OFFSETS: (16, offsets[:bands].ravel().tolist()), TILE_COUNTS: (16, counts[:bands].ravel().tolist()), SAMPLE_FORMAT: (3, [1] * bands),
                PIXEL_SCALE: (12, [grid.res, grid.res, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, grid.minx, grid.maxy, 0.0]), GEO_KEYS: (3, _geo_keys(grid.epsg)),
            }]
            if mask:
                directories.append(size | {SUBFILE: (4, [MASK]), BITS: (3, [1]), PHOTOMETRIC: (3, [4]), SAMPLES: (3, [1]), PLANAR: (3, [1]), TILE_OFFSETS: (16, offsets[bands].tolist()), TILE_COUNTS: (16, counts[bands].tolist())})
            link = 8
            for tags in directories:
                entries = []
                for tag, (code, values) in sorted(tags.items()):
                    data = values if code == 2 else struct.pack(f"<{len(values)}{_FORMATS[code]}", *values)
                    entries.append(struct.pack("<HHQ", tag, code, len(values)) + (data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", put(data)[0])))
                at, _ = put(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
                out.seek(link)
                out.write(struct.pack("<Q", at))
                out.seek(0, os.SEEK_END)
                link = at + 8 + 20 * len(entries)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write(path: str, tiles: Iterable[tuple[int, int, np.ndarray]], grid: Grid, bands: int, dtype: str = "uint16", tile: int = 256, names: list[str] | None = None) -> None:
    """Write (row, column, array of band, h, w) pieces that start at multiples of ``tile``."""

    def blocks() -> Iterator[tuple[int, int, bytes]]:
        for r, c, array in tiles:
            first = place_of(r, c, grid, tile)
            for y in range(0, array.shape[1], tile):
                for x in range(0, array.shape[2], tile):
                    for b in range(bands):
                        yield b, first + y // tile * -(-grid.width // tile) + x // tile, encode(array[b, y : y + tile, x : x + tile].astype(dtype), tile)

    assemble(path, blocks(), grid, bands, dtype, tile, names)


class Image:
    """One directory of a file: its size and how its blocks are laid out."""

    def __init__(self, tags: dict, path: str):
        self.tags = tags
        self.width, self.height = tags[WIDTH][0], tags[LENGTH][0]
        self.bands, self.bits = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])[0]
        self.kind = tags.get(SUBFILE, [0])[0]
        self.chunky = tags.get(PLANAR, [1])[0] == 1 and self.bands > 1
        self.compression, self.predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
        if TILE_OFFSETS in tags:
            self.tile_w, self.tile_h, self.offsets, self.counts = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            self.tile_w, self.tile_h, self.offsets, self.counts = self.width, min(tags.get(STRIP_ROWS, [self.height])[0], self.height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        if self.compression not in (NONE, DEFLATE, OLD_DEFLATE) or self.predictor not in (1, 2) or self.bits not in (1, 8, 16):
            raise ValueError(f"{path}: compression {self.compression}, predictor {self.predictor} and {self.bits} bits are not supported")
        self.dtype = np.dtype(bool) if self.bits == 1 else np.dtype(f"{'i' if tags.get(SAMPLE_FORMAT, [1])[0] == 2 else 'u'}{self.bits // 8}")


class Reader:
    """Windows of a GeoTIFF.  ``fetch(offset, size)`` reads bytes; without it the file is opened."""

    def __init__(self, path: str, fetch: Callable[[int, int], bytes] | None = None):
        self.file = None if fetch is not None else open(path, "rb")  # noqa: SIM115  closed by close()
        self.fetch = fetch or self._fetch
        head = self.fetch(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        version = struct.unpack_from(f"{self.order}H", head, 2)[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF")
        self.big = version == 43
        at = struct.unpack_from(f"{self.order}{'Q' if self.big else 'I'}", head, 8 if self.big else 4)[0]
        images = []
        while at:
            tags, at = self._directory(at)
            images.append(Image(tags, path))
        self.image = images[0]
        #: the image itself and its overviews, the finest first
        self.levels = sorted([i for i in images if i is self.image or i.kind & REDUCED and not i.kind & MASK], key=lambda i: -i.width)
        self.mask = next((i for i in images if i.kind == MASK), None)
        tags = self.image.tags
        self.bands, self.dtype, self.tile = self.image.bands, self.image.dtype, self.image.tile_w
        keys = tags.get(GEO_KEYS, [])
        codes = {k: v for k, place, _, v in zip(keys[4::4], keys[5::4], keys[6::4], keys[7::4], strict=False) if not place}
        self.grid = Grid(tags.get(PIXEL_SCALE, [1.0])[0], tags.get(TIEPOINT, [0.0] * 6)[3], tags.get(TIEPOINT, [0.0] * 6)[4], self.image.width, self.image.height, next((codes[k] for k in _CRS_KEYS if k in codes), 0))
        self.names = [x for x in tags.get(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace").split("|") if x]

    def _fetch(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _directory(self, at: int) -> tuple[dict, int]:
        wide, entry, count, link = ("Q", 20, "Q", 8) if self.big else ("I", 12, "H", 4)
        n = struct.unpack(self.order + count, self.fetch(at, struct.calcsize(count)))[0]
        at += struct.calcsize(count)
        raw = self.fetch(at, n * entry + link)
        tags = {}
        for i in range(n):
            tag, code, size = struct.unpack_from(f"{self.order}HH{wide}", raw, i * entry)
            inline = raw[i * entry + entry - link : (i + 1) * entry]
            length = size * _SIZES.get(code, 1)
            data = inline[:length] if length <= link else self.fetch(struct.unpack(self.order + wide, inline)[0], length)
            if code in _FORMATS:
                tags[tag] = list(struct.unpack(f"{self.order}{size}{_FORMATS[code]}", data))
            elif code == 2:
                tags[tag] = data
        return tags, struct.unpack_from(self.order + wide, raw, n * entry)[0]

    def _block(self, image: Image, number: int, bands: int) -> np.ndarray:
        """Block (rows, columns, bands)."""
        shape = (image.tile_h, image.tile_w, bands)
        if not image.counts[number]:
            return np.zeros(shape, image.dtype)
        data = self.fetch(image.offsets[number], image.counts[number])
        data = data if image.compression == NONE else zlib.decompress(data)
        if image.bits == 1:
            packed = np.frombuffer(data, np.uint8).reshape(-1, -(-image.tile_w // 8))
            block = np.unpackbits(packed, axis=1)[:, : image.tile_w, None].astype(bool)
        else:
            block = np.frombuffer(data, image.dtype.newbyteorder(self.order)).reshape(-1, image.tile_w, bands).astype(image.dtype)
        if image.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        return block if len(block) == image.tile_h else np.concatenate((block, np.zeros((image.tile_h - len(block), *shape[1:]), image.dtype)))

    def window(self, row: int, col: int, height: int, width: int, image: Image | None = None) -> np.ndarray:
        """Bands of a window; places outside the raster are zero."""
        image = image or self.image
        out = np.zeros((image.bands, height, width), image.dtype)
        th, tw = image.tile_h, image.tile_w
        across, down = -(-image.width // tw), -(-image.height // th)
        for ty in range(max(0, row // th), min(down, (row + height - 1) // th + 1)):
            for tx in range(max(0, col // tw), min(across, (col + width - 1) // tw + 1)):
                y0, x0 = max(row, ty * th), max(col, tx * tw)
                y1, x1 = min(row + height, (ty + 1) * th, image.height), min(col + width, (tx + 1) * tw, image.width)
                if y1 <= y0 or x1 <= x0:
                    continue
                number = ty * across + tx
                planes = [self._block(image, number, image.bands)] if image.chunky else [self._block(image, b * across * down + number, 1) for b in range(image.bands)]
                block = planes[0] if len(planes) == 1 else np.concatenate(planes, axis=2)
                out[:, y0 - row : y1 - row, x0 - col : x1 - col] = block[y0 - ty * th : y1 - ty * th, x0 - tx * tw : x1 - tx * tw].transpose(2, 0, 1)
        return out

    def level_for(self, res: float) -> tuple[Image, Grid]:
        """The coarsest level that is not coarser than a resolution, and its grid."""
        fit = [i for i in self.levels if self.grid.res * self.image.width / i.width <= res * 1.0001] or self.levels[:1]
        return fit[-1], replace(self.grid, res=self.grid.res * self.image.width / fit[-1].width, width=fit[-1].width, height=fit[-1].height)

    def decimated(self, height: int, width: int) -> np.ndarray:
        """The whole raster at another size: each pixel takes the source pixel at floor(i * source / size)."""
        image, grid = self.level_for(self.grid.res * self.image.width / width)
        rows, cols = np.arange(height) * image.height // height, np.arange(width) * image.width // width
        out = np.zeros((image.bands, height, width), image.dtype)
        for y in range(0, height, 256):  # strips bound the memory
            part = rows[y : y + 256]
            out[:, y : y + 256] = self.window(int(part[0]), 0, int(part[-1] - part[0]) + 1, image.width, image)[:, part - part[0]][:, :, cols]
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def scaled(grid: Grid, width: int, height: int) -> Grid:
    """The grid of the same area in another number of pixels."""
    return replace(grid, res=grid.res * grid.width / width, width=width, height=height)
