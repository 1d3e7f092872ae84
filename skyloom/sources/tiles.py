"""A Spark data source of packed tiles from GeoTIFF files: one row for each file and tile.

``spark.read.format("skyloom_tiles").option("tile", 512).load(path)`` after
``spark.dataSource.register(TileSource)``; partitions are tiles, so reads are
spread over executors and only the tile's blocks are decoded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .geotiff import Reader
from .retry import retried


class TilePartition(InputPartition):
    def __init__(self, path: str, row: int, col: int, height: int, width: int):
        self.path, self.row, self.col, self.height, self.width = path, row, col, height, width


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tile", "512"))

    def partitions(self) -> list[TilePartition]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.lower().endswith((".tif", ".tiff"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for f in files:
            reader = Reader(f)
            g = reader.grid
            reader.close()
            out += [TilePartition(f, r, c, min(self.tile, g.height - r), min(self.tile, g.width - c)) for r in range(0, g.height, self.tile) for c in range(0, g.width, self.tile)]
        return out

    def read(self, partition: TilePartition) -> Iterator[tuple]:
        def window():
            reader = Reader(partition.path)
            try:
                return reader.window(partition.row, partition.col, partition.height, partition.width).astype("<u2")
            finally:
                reader.close()

        data = retried(window)
        yield os.path.basename(partition.path), partition.row, partition.col, partition.height, partition.width, data.shape[0], data.tobytes()


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skyloom_tiles"

    def schema(self) -> str:
        return "file string, r bigint, c bigint, h bigint, w bigint, k bigint, bands binary"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)
