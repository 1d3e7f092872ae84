"""Mosaics that grow as scenes arrive (Structured Streaming).

Mean, count and first have small mergeable state: sums, counts and the lowest
rank.  Other methods need the whole stack of a pixel, so a micro-batch rebuilds
the tiles that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reduce


def running_mean(stream: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Complete-mode aggregation: integer means and counts of all that has arrived."""
    return reduce.mean(reduce.source_valid(stream, bands), pixel, bands)


def running_first(stream: DataFrame, pixel: Sequence[str], bands: Sequence[str], rank: str = "rank") -> DataFrame:
    return reduce.first(reduce.source_valid(stream, bands), pixel, bands, rank)


def rebuild_tiles(stream: DataFrame, stored: Callable[[], DataFrame], save: Callable[[DataFrame], None], tile: Sequence[str], build: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """For every micro-batch, ``build`` the observations of the tiles that it touches and ``save`` them.

    ``stored`` reads all observations so far, the batch's included (the writer of
    observations runs first, so a repeated batch rebuilds the same tiles).
    """

    def step(batch: DataFrame, _: int) -> None:
        touched = batch.select(*tile).distinct()
        save(build(stored().join(F.broadcast(touched) if touched.count() < 100_000 else touched, list(tile), "left_semi")))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
